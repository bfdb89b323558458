"""Logs, listings, audio files, streams: round trips, broken inputs and reruns."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resonant.operators import runs

from resonant.operators import relational as R
from resonant.operators.signal_udf import track_reports
from resonant.sources import audio, records
from resonant.streaming import logs

LINES = """{"status":"done","model_id":"a","duration_s":15.0,"prompt_id":"p","set_idx":0,"track_idx":0,"orig_peak":0.5}
{broken
{"status":"not_applicable","model_id":"b","duration_s":30.0,"reason":"above native"}

{"status":"done","model_id":"a","duration_s":15.0,"prompt_id":"p","set_idx":0,"track_idx":0,"orig_peak":NaN}
"""


def test_jsonl(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(LINES)
    rows = records.read_jsonl(spark, str(tmp_path / "m.jsonl"))
    assert rows.count() == 3 and records.done_records(rows).count() == 2
    done, na = records.resume_keys(rows)
    assert done.count() == 1 and na.count() == 1
    last = R.latest_per_key(records.done_records(rows), records.TRACK_KEY, F.col("seq")).first()
    assert np.isnan(last.orig_peak)
    assert records.read_jsonl(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_resume_is_idempotent(spark):
    plan = spark.range(20).select(F.col("id").alias("k"))
    done = spark.range(5).select(F.col("id").alias("k"))
    rest = R.pending(plan, done, ["k"])
    assert rest.count() == 15 and R.pending(plan, done.union(rest), ["k"]).count() == 0


def test_audio(spark, tmp_path):
    y = audio.melody(3)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.wav").write_bytes(audio.encode_wav(y, 22050))
    (tmp_path / "b.wav").write_bytes(b"RIFFnothing")
    (tmp_path / "c.txt").write_text("no audio")
    got = {r.path.rsplit("/", 1)[1]: r for r in audio.read_audio(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.wav", "b.wav"} and got["b.wav"].error
    assert got["a.wav"].sr == 22050 and np.allclose(got["a.wav"].samples, y, atol=1e-6)
    assert records.list_files(spark, str(tmp_path), [".WAV"]).count() == 2
    stereo = np.zeros((2, 100), np.float32)
    assert audio.to_mono(stereo).shape == (100,) and audio.to_mono(stereo.T).shape == (100,)


def test_reports_keep_failures(spark):
    tracks = spark.createDataFrame([("ok", 44100, np.repeat(audio.melody(6), 2).tolist()), ("short", 22050, [0.0] * 10), ("none", 22050, None)], "id string, sr int, samples array<float>")
    got = {r.id: r for r in track_reports(tracks).collect()}
    assert got["ok"].error is None and abs(got["ok"].report.degeneracy.duration_s - 6) < 0.01
    assert "ValueError" in got["short"].error and got["none"].report is None


def test_streams(spark, tmp_path):
    schema = "k long, v long, seq long"
    src, sink, check = (str(tmp_path / n) for n in ("src", "sink", "check"))
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    spark.createDataFrame([(1, 10, 0), (2, 20, 1)], schema).coalesce(1).write.json(src)
    keep = lambda: logs.keep_latest(logs.stream_jsonl(spark, src, kind), ["k"], "seq", sink, check, compact_every=2).awaitTermination()
    for _ in range(2):  # the second run finds nothing new
        keep()
    for k, v, seq in ((1, 11, 5), (3, 30, 6), (3, 29, 2)):
        spark.createDataFrame([(k, v, seq)], schema).coalesce(1).write.mode("append").json(src)
        keep()
    assert sorted(tuple(r) for r in logs.read_latest(spark, ["k"], "seq", sink).select("k", "v").collect()) == [(1, 11), (2, 20), (3, 30)]
    assert {p.name for p in (tmp_path / "sink" / "base").iterdir()} == {"v=1", "v=3"}
    shutil.rmtree(tmp_path / "sink" / "base")
    shutil.rmtree(tmp_path / "sink" / "delta" / "v=1")
    with pytest.raises(RuntimeError, match="missing"):
        logs.read_latest(spark, ["k"], "seq", sink)


def test_stream_callback_and_first_records(spark, tmp_path):
    kind = T.StructType.fromDDL("k long, v long")
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, 1), (2, 2), (2, 3)], kind).coalesce(1).write.json(src)
    seen, done = [], spark.createDataFrame([(1,)], "k long")
    logs.on_track(logs.stream_jsonl(spark, src, kind), lambda: done, ["k"], lambda rows: seen.extend(r.k for r in rows.collect()), str(tmp_path / "c1")).awaitTermination()
    assert sorted(seen) == [2, 2]
    first = logs.first_of_each(logs.stream_jsonl(spark, src, kind), ["k"])
    first.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.table("firsts").collect()) == [1, 2]


def test_strict_reading_and_appending(spark, tmp_path):
    path = str(tmp_path / "log")
    row = spark.createDataFrame([("a", 15.0, None)], "model_id string, duration_s double, reason string")
    records.append_jsonl(row, path)
    records.append_jsonl(row, path)
    got = records.read_jsonl(spark, path, "model_id string, duration_s double, reason string", strict=True)
    assert got.count() == 2 and not any("reason" in line for p in (tmp_path / "log").glob("*.json") for line in p.read_text().splitlines())
    (tmp_path / "bad.jsonl").write_text('{"model_id": "a"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        records.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "model_id string", strict=True).collect()


def test_configuration_and_documents(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"models": [{"id": "a", "sr": 44100}, {"id": "b"}]}')
    items = records.read_config(str(tmp_path / "c.json"))["models"]
    assert [tuple(r) for r in records.dimension(spark, items, "id string, sr int").collect()] == [("a", 44100), ("b", None)]
    (tmp_path / "d.json").write_text('[\n {"file": "x",\n  "piece": "p"},\n {"file": "y", "piece": "q"}]')
    assert records.read_documents(spark, str(tmp_path / "d.json")).count() == 2
    records.write_summaries(spark.createDataFrame([(15.0, "a"), (30.0, "b")], "duration_s double, model_id string"), str(tmp_path / "s"))
    assert records.directories(spark, str(tmp_path / "s"), "duration_s=*") == ["duration_s=15.0", "duration_s=30.0"]
    assert records.directories(spark, str(tmp_path), "none*") == []
    (tmp_path / "k" / "deep").mkdir(parents=True)
    for n in ("k", "k/deep"):
        (tmp_path / n / "m.jsonl").write_text("one\ntwo\n")
    found = records.discover_logs(spark, str(tmp_path / "k"), "m.jsonl")
    assert found.count() == 4 and runs.merged_lines(found, ["path", "place"]).count() == 2


def test_levels_headers_and_reference_segments(spark, tmp_path):
    y = audio.sine(220.0, 2.5, amp=0.25)
    tracks = spark.createDataFrame([("a/x.wav", 22050, y.tolist()), ("e.wav", 22050, [])], "file string, sr int, samples array<float>")
    made = {r.file: r for r in audio.write_files(audio.encoded(tracks, bits=16), str(tmp_path / "out")).collect()}
    assert abs(made["a/x.wav"].orig_peak - 0.25) < 1e-4 and abs(made["a/x.wav"].orig_rms - 0.25 / 2**0.5) < 1e-3 and made["e.wav"].orig_peak == 0.0
    (tmp_path / "out" / "broken.wav").write_bytes(b"RIFF")
    probed = {r.path.rsplit("/", 1)[1]: r for r in audio.probe(spark, str(tmp_path / "out")).collect()}
    assert abs(probed["x.wav"].duration_s - 2.5) < 1e-3 and probed["x.wav"].sr == 22050 and probed["broken.wav"].error
    ready = {r.path.rsplit("/", 1)[1]: r for r in audio.read_for_analysis(spark, str(tmp_path / "out"), 11025).collect()}
    assert len(ready["x.wav"].samples) == round(len(y) / 2) and abs(max(ready["x.wav"].samples) - 0.9) < 0.01 and ready["broken.wav"].error
    pieces = audio.read_audio(spark, str(tmp_path / "out" / "a"))
    windows = pieces.select(F.col("path").alias("piece"), F.explode(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))).alias("start_s")).withColumn("duration_s", F.lit(1.0)).withColumn("idx", F.col("start_s").cast("int"))
    cut = audio.reference_segments(windows, pieces).collect()  # the third is not filled
    assert sorted(r.file for r in cut) == ["x_0s_1s_00000.wav", "x_1s_1s_00001.wav"] and all(r.actual_duration_s == 1.0 for r in cut)
    rate, back = audio.decode_wav(bytes(cut[0].content))
    assert rate == 22050 and abs(np.abs(back).max() - 0.9) < 1e-3


def test_kinds_and_registries(spark):
    assert runs.resolve_kind("float16", None) == "float32" and runs.resolve_kind("bfloat16", 8.6) == "bfloat16"
    with pytest.raises(runs.Unsupported):
        runs.resolve_kind("bfloat16", 7.5)
    with pytest.raises(ValueError):
        runs.resolve_kind("int3", None)
    for kind, has in (("bfloat16", 7.5), ("int3", 8.0), (None, 8.0)):
        with pytest.raises(Exception, match="not supported|unknown kind"):
            runs.checked_kinds(spark.createDataFrame([(kind, has)], "kind string, has double"), "kind", "has").collect()
    with pytest.raises(KeyError, match="identity"):
        runs.CODECS["mp3"]
    assert set(runs.fingerprint()) >= {"host", "python", "spark"}
    wanted, cache = spark.range(3).withColumnRenamed("id", "k"), spark.createDataFrame([(0, 1.0)], "k long, v double")
    with pytest.raises(Exception, match="unresolved"):
        runs.cached_or_computed(wanted, cache, "k", "v", lambda rows: rows.where("k = 1").withColumn("v", F.lit(2.0))).collect()
