"""Record sources and sinks: append-only JSONL logs, configuration, listings."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACK_KEY = ["model_id", "duration_s", "prompt_id", "set_idx", "track_idx"]

MANIFEST = (
    "status string, model_id string, duration_s double, prompt_id string, prompt_category string, loop_eval boolean, set_idx int, track_idx int, seed long, "
    "wav_path string, sr int, channels int, requested_duration_s double, actual_duration_s double, orig_peak double, orig_rms double, wall_time_s double, peak_vram_gb double, reason string")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str = MANIFEST, strict: bool = False) -> DataFrame:
    """A JSONL log with seq, the order of its lines.

    A missing file is an empty log. Broken lines are skipped, or raise when
    ``strict``. seq grows with the line within a file's split and with the split.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not _exists(spark, path):
        return spark.createDataFrame([], schema.add("seq", T.LongType()) if "seq" not in schema.names else schema)
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()).where("trim(value) <> ''")
    if strict:
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "seq").select("r.*", "seq")
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "seq")
    return rows.where("r._corrupt is null").select(*[F.col("r")[n].alias(n) for n in schema.names], "seq")


def done_records(manifest: DataFrame) -> DataFrame:
    return manifest.where("status = 'done'")


def resume_keys(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys of finished tracks, and the cells that do not apply."""
    return (done_records(manifest).select(*TRACK_KEY).distinct(), manifest.where("status = 'not_applicable'").select("model_id", "duration_s").distinct())


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append a batch; nulls are left out as absent keys, each task writes a file of its own."""
    rows.write.mode("append").json(path)


def read_config(path: str) -> dict:
    """A YAML or JSON configuration file, on the driver: dimensions, not data."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def dimension(spark: SparkSession, items: list[dict], schema: str) -> DataFrame:
    """Configuration items as a small table; missing keys are null."""
    kind = T.StructType.fromDDL(schema)
    return spark.createDataFrame([[i.get(n) for n in kind.names] for i in items], kind)


def read_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents that span lines, one or more files of them, read on the executors."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def directories(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """The names of the folders below ``root`` that fit a pattern, sorted; a listing, no file is opened."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(f.getPath().getName() for f in found or [] if f.isDirectory())


def discover_logs(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, place, line) of every log of that name at any depth below ``root``."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root)
    return found.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))


def list_files(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """path, size and time of the files below a folder with one of the suffixes, in any case; contents are not read."""
    match = "|".join(s.lstrip(".").lower() for s in suffixes)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", "length", "modificationTime").where(F.lower("path").rlike(rf"\.({match})$"))


def write_summaries(rows: DataFrame, path: str, by: str = "duration_s") -> None:
    """One JSON folder for each duration."""
    rows.write.mode("overwrite").partitionBy(by).json(path)
