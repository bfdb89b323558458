"""Statistics, set distances and the whole way from a plan to the decision."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resonant.functions import stats
from resonant.operators import bootstrap as B
from resonant.operators import distances as D
from resonant.operators import relational as R
from resonant.operators import runs
from resonant.operators import signal_udf as U
from resonant.operators import summary as S
from resonant.sources import audio as A

SR = 22050


def test_t_quantiles_at_any_degrees(spark):
    got = spark.range(1, 400).select("id", stats.t_column(F.col("id")).alias("t")).collect()
    assert all(abs(r.t - stats.t_quantile(r.id)) < 2e-6 for r in got)


def test_bootstrap_interval_of_a_mean_and_of_nothing(spark):
    v = np.random.default_rng(1).normal(0.7, 0.05, 300)
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double")
    r = B.bootstrap_ci(rows, [], ["i"], resamples=400).first()
    se = v.std() / 300**0.5
    assert abs(r.point - v.mean()) < 1e-12 and abs(r.boot_std / se - 1) < 0.15 and abs((r.ci_hi - r.ci_lo) / (3.92 * se) - 1) < 0.15
    assert B.bootstrap_ci(rows, [], ["i"], resamples=400).first() == r
    with pytest.raises(Exception, match="no observations"):
        B.bootstrap_ci(rows.limit(0), [], ["i"]).collect()


def test_set_distances_equal_numpy(spark):
    rng = np.random.default_rng(0)
    ref, ev = rng.normal(1000.0, 1, (90, 5)), rng.normal(1000.3, 1.2, (60, 5))
    frame = lambda x, files: spark.createDataFrame([(i, i % files, v.tolist()) for i, v in enumerate(x)], "id long, file long, x array<double>").repartition(3)
    r, e = frame(ref, 9), frame(ev, 6)
    g = D.gauss_stats(r, 5).first()
    assert np.allclose(g.mu, ref.mean(0)) and np.allclose(np.reshape(g.sigma, (5, 5)), np.cov(ref.T), rtol=1e-9)  # a large mean loses no digits
    sq = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(-1)
    bw = np.sqrt(np.median(sq(ref, ref)[np.triu_indices(90, 1)]))
    assert abs(D.median_bandwidth(r).first().bandwidth - bw) < 1e-9
    assert D.squared_distances(r, size=20).count() == 90 * 89 // 2
    k = lambda a, b: np.exp(-sq(a, b) / (2 * bw * bw))
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    kad = off(k(ref, ref)) + off(k(ev, ev)) - 2 * k(ref, ev).mean()
    fad = D.frechet(ref.mean(0), np.cov(ref.T), ev.mean(0), np.cov(ev.T))
    got = {x.metric: x for x in D.evaluate_set(D.ReferenceContext(r, 5), e, 60).collect()}
    assert abs(got["kad"].point - kad) < 1e-9 and abs(got["fad"].point - fad) < 1e-6
    weights = {}
    for w in B.weight_rows(e.groupBy("file").agg(F.count("*").alias("n")), ["file"], 60).collect():
        weights.setdefault(w.b, {})[w.file] = w.w
    kads, fads = [], []
    for chosen in weights.values():
        x = np.concatenate([np.repeat(ev[f::6][None], w, 0).reshape(-1, 5) for f, w in chosen.items()])
        n = len(x)
        same = np.concatenate([np.tile(np.arange(f, 60, 6), w) for f, w in chosen.items()])
        kk = k(x, x)
        trace = sum(w for f, w in chosen.items() for _ in range(f, 60, 6))
        kads.append(off(k(ref, ref)) + (kk.sum() - trace) / (n * (n - 1)) - 2 * k(ref, x).mean())
        fads.append(D.frechet(ref.mean(0), np.cov(ref.T), x.mean(0), np.cov(x.T)))
        assert len(same) == n
    assert np.allclose([got["kad"].ci_lo, got["kad"].ci_hi], np.percentile(kads, [2.5, 97.5]), atol=1e-9)
    assert np.allclose([got["fad"].ci_lo, got["fad"].ci_hi], np.percentile(fads, [2.5, 97.5]), atol=1e-6) and got["fad"].n_resamples == len(weights)


def test_tiles_are_shuffled_once_for_all_their_pairs(spark):
    x = np.random.default_rng(2).normal(0, 1, (90, 4))
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, file long, x array<double>")
    df = D.squared_distances(rows, size=6)
    got = {(r.a, r.b): r.d2 for r in df.collect()}
    assert len(got) == 90 * 89 // 2 and all(a < b and abs(d - ((x[a] - x[b]) ** 2).sum()) < 1e-9 for (a, b), d in got.items())
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "CartesianProduct" in plan and "Generate" not in plan and "ReusedExchange" in plan
    assert D.squared_distances(rows.limit(0)).count() == 0 and D.squared_distances(rows.limit(1)).count() == 0


def test_onsets_chroma_and_tempo_drift():
    y = A.clicks(12, 120)
    env = U.onset_envelope(y, SR)
    assert abs(len(U.onsets(env, SR)) - 24) <= 2
    drift = U.tempo_drift(env, SR)
    assert drift["n_windows"] > 3 and drift["cv"] < 0.02 and abs(drift["global_bpm"] - 120) < 3
    c = U.chroma(sum(A.sine(f, 3, amp=0.2) for f in (261.63, 329.63, 392.0)), SR).mean(axis=1)
    assert set(np.argsort(c)[-3:]) == {0, 4, 7} and U.key(c)[0] == "C major"


def test_from_plan_to_decision(spark):
    """One model makes melodies, the other a constant tone and nothing above its native length; the tone never passes."""
    models = spark.createDataFrame([("good", "melody", 120.0), ("drone", "drone", 20.0)], "model_id string, generator string, native double")
    durations = spark.createDataFrame([(15.0,), (30.0,)], "duration_s double")
    prompts = spark.createDataFrame([("battle", 0, None), ("fanfare", 1, False)], "prompt_id string, prompt_idx int, loop_eval boolean")
    k = R.replicates_for(F.col("model_id"), F.col("duration_s"), ["good"], ["drone"], [15.0, 30.0], 2, 1, 1)
    plan = R.plan_runs(models, durations, prompts, k, 2)
    plan = plan.withColumn("seed", R.make_seed(0, F.col("set_idx"), F.col("prompt_idx"), F.col("track_idx"))).withColumn("status", F.when(F.col("duration_s") > F.col("native"), "not_applicable").otherwise("planned"))
    ran = runs.cut_at_failure(plan, ["set_idx", "prompt_idx", "track_idx"])
    assert {(r.model_id, r.status): r["count"] for r in ran.groupBy("model_id", "status").count().collect()} == {("good", "planned"): 16, ("drone", "planned"): 4, ("drone", "not_applicable"): 1}
    assert runs.scoped(plan, models=["good"], durations=[15.0], sets=[0], max_tracks=1).count() == 2
    made = A.generate(ran.where("status = 'planned'").withColumn("seconds", F.lit(15.0)).repartition(4))
    made = made.withColumn("id", F.concat_ws("|", "model_id", F.col("duration_s").cast("string"), "prompt_id", F.col("seed").cast("string"))).withColumn("sr", F.lit(SR))
    made = made.withColumn("orig_peak", F.array_max(F.transform("samples", lambda v: F.abs(v))).cast("double")).withColumn("actual_duration_s", F.size("samples") / F.col("sr"))
    rows = made.drop("samples").join(U.track_reports(made.select("id", "sr", "samples")), "id").withColumn("clap_score", F.when(F.col("model_id") == "drone", 0.9).otherwise(0.1))
    reports = spark.createDataFrame(S.report_table(rows).collect(), S.report_table(rows).schema)
    summary = {(r.model_id, r.duration_s): r for r in S.per_track_summary(reports, ["id"], resamples=50).collect()}
    assert set(summary) == {("good", 15.0), ("good", 30.0), ("drone", 15.0)}
    drone, good = summary["drone", 15.0], summary["good", 15.0]
    assert drone.degenerate.p == 1.0 and drone.degenerate_reasons["static_signal"] == 4 and good.degenerate.p == 0.0
    assert (good.n_tracks, good.n_loop_tracks) == (8, 4) and drone.seam_pass_naive.p == 0.0 and drone.grid_pass_best.p == 0.0
    assert abs(good.actual_duration_s.point - 15) < 0.01 and good.clap.ci_lo <= good.clap.point <= good.clap.ci_hi and set(good.clap_by_prompt) == {"battle", "fanfare"}
    verdicts = {r.verdict_key: r for r in S.decide(reports).collect()}
    assert len(verdicts) == 6 and not any(v["pass"] for n, v in verdicts.items() if n.startswith("drone"))
    assert verdicts["drone|15.0|naive"].clap and not verdicts["good|15.0|naive"].clap and {v.branch for v in verdicts.values()} == {1}


def test_undefined_measures_never_pass(spark):
    kind = T.StructType.fromDDL(
        "model_id string, duration_s double, prompt_id string, loop_eval boolean, degeneracy struct<degenerate:boolean,reasons:array<string>>, "
        "game struct<seam_naive_ok:boolean,best_loop:struct<best_seam_ok_p95:boolean>,grid_naive:struct<seam_gap_beat_error:double,bar_fraction_error:double,degenerate:boolean>,grid_best_loop:struct<seam_gap_beat_error:double,bar_fraction_error:double,degenerate:boolean>>, clap_score double")
    fine, nan = (0.05, 0.05, False), (float("nan"), 0.05, False)
    rows = [("a", 15.0, "p", None, (False, []), (True, (True,), fine, fine), 0.5), ("a", 15.0, "p", True, (False, []), (None, (True,), nan, (0.05, 0.05, True)), None),
            ("a", 15.0, "p", True, None, None, 0.7), ("a", 15.0, "p", False, (False, []), (True, (True,), fine, fine), None), ("a", 15.0, "q", True, (True, ["noise_like"]), (True, (True,), fine, fine), None)]
    got = S.cell_proportions(spark.createDataFrame(rows, kind)).first()
    assert (got.n_tracks, got.n_loop_tracks) == (5, 3)
    assert [round(got[f"{n}_pass_{v}"].p * 3) for n in ("seam", "grid") for v in S.VARIANTS] == [1, 2, 1, 1]
    assert not any(r["pass"] for r in S.decide(spark.createDataFrame(rows, kind)).collect())
    assert S.decide(spark.createDataFrame([], kind)).count() == 0
