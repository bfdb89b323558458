"""Streaming forms of resuming and of late corrections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import latest_per_key, pending


def stream_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A folder of JSONL files as a stream."""
    return spark.readStream.schema(schema).json(path)


def first_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Records of keys that were not seen before (the streaming form of the resume key set)."""
    return rows.dropDuplicates(keys)


def keep_latest(rows: DataFrame, keys: list[str], order: str, sink: str, checkpoint: str, compact_every: int = 16):
    """Keep the latest record of each key; a newer row supersedes.

    Each micro-batch writes its own latest records as a delta, so its cost follows the
    batch; every so many deltas are merged into a base. A batch that is run again writes
    its own number again, so a restart changes nothing. ``read_latest`` gives the table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        latest_per_key(batch, keys, F.col(order)).select(*batch.columns).write.mode("overwrite").parquet(f"{sink}/delta/v={number}")
        if (number + 1) % compact_every == 0:
            read_latest(batch.sparkSession, keys, order, sink, number).write.mode("overwrite").parquet(f"{sink}/base/v={number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions below a path that were written whole."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(int(f.getPath().getParent().getName()[2:]) for f in found or [])


def read_latest(spark: SparkSession, keys: list[str], order: str, sink: str, upto: int | None = None) -> DataFrame:
    """The latest record of each key as of a batch (by default the last): the newest base and the deltas after it."""
    deltas = [v for v in _versions(spark, f"{sink}/delta") if upto is None or v <= upto]
    if not deltas:
        raise ValueError(f"no batch was kept below {sink}")
    base = max((v for v in _versions(spark, f"{sink}/base") if v < deltas[-1] or (upto is None and v == deltas[-1])), default=-1)
    wanted = list(range(base + 1, deltas[-1] + 1))
    if missing := sorted(set(wanted) - set(deltas)):
        raise RuntimeError(f"batches {missing} are missing below {sink}")
    paths = [f"{sink}/base/v={base}"] * (base >= 0) + [f"{sink}/delta/v={v}" for v in wanted]
    parts = [spark.read.parquet(p) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return latest_per_key(out, keys, F.col(order)).select(*parts[0].columns)


def on_track(rows: DataFrame, done: Callable[[], DataFrame], keys: list[str], work: Callable[[DataFrame], None], checkpoint: str):
    """Call ``work`` with the records of each micro-batch that are not done yet."""
    return (rows.writeStream.foreachBatch(lambda batch, _: work(pending(batch, done(), keys)))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
