"""Controlling a run: scoping a plan, cells that do not apply, what counts as done, archives, capabilities and lineage."""

from __future__ import annotations

import platform
from collections.abc import Callable, Sequence

import numpy
import pyarrow
import pyspark
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["model_id", "duration_s"]


def scoped(plan: DataFrame, models: Sequence[str] | None = None, durations: Sequence[float] | None = None, sets: Sequence[int] | None = None, max_tracks: int | None = None) -> DataFrame:
    """The part of a plan that was asked for; what is not named is not restricted."""
    for column, wanted in (("model_id", models), ("duration_s", durations), ("set_idx", sets)):
        if wanted is not None:
            plan = plan.where(F.col(column).isin(list(wanted)))
    return plan if not max_tracks else plan.where(F.col("track_idx") < max_tracks)


def cut_at_failure(runs: DataFrame, order: Sequence[str], failed: str = "not_applicable") -> DataFrame:
    """What a run makes of a plan whose cells end at their first ``failed`` status.

    Rows of a cell before it stay, the first one stands for the cell, those after it
    never run. One aggregate per cell, joined back.
    """
    place = F.struct(*order)
    first = runs.where(F.col("status") == failed).groupBy(*CELL).agg(F.min(place).alias("_first"))
    return runs.join(first, CELL, "left").where(F.col("_first").isNull() | (place <= F.col("_first"))).drop("_first")


def merged_fields(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Records with newly computed fields laid over them; a field that was not computed keeps its value."""
    names = [c for c in old.columns if c not in fields]
    added = new.select(*keys, F.lit(True).alias("_new"), *[F.col(f).alias(f"_{f}") for f in fields])
    value = lambda f: F.when(F.col("_new"), F.coalesce(F.col(f"_{f}"), F.col(f)) if f in old.columns else F.col(f"_{f}")).otherwise(F.col(f) if f in old.columns else F.lit(None))
    return old.join(added, list(keys), "left").select(*names, *[value(f).alias(f) for f in fields])


def done_for(records: DataFrame, keys: Sequence[str], needed: Sequence[str] = ()) -> DataFrame:
    """The keys that need no more work: a record counts only if it has every needed field."""
    for field in needed:
        records = records.where(F.col(field).isNotNull())
    return records.select(*keys).distinct()


def split_missing(records: DataFrame, files: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The records whose file is there, and those to be skipped with a warning; ``files`` lists path."""
    there = files.select(F.col("path").alias(path)).distinct()
    return records.join(there, path, "left_semi"), records.join(there, path, "left_anti")


def archived(files: DataFrame, cell: Sequence[str], audio: Sequence[str] = ("wav", "flac"), per_cell: int = 2, without: str = "/convert/") -> DataFrame:
    """The files that go into an archive: none below ``without``, audio up to ``per_cell`` of each cell, all others.

    Only audio files are ranked; the others are not moved.
    """
    rows = files.where(~F.contains("path", F.lit(without)))
    is_audio = F.lower("path").rlike(rf"\.({'|'.join(audio)})$")
    ranked = rows.where(is_audio).withColumn("_rank", F.row_number().over(Window.partitionBy(*cell).orderBy("path"))).where(F.col("_rank") <= per_cell).drop("_rank")
    return rows.where(~is_audio).unionByName(ranked)


def merged_lines(parts: DataFrame, order: Sequence[str], line: str = "line") -> DataFrame:
    """Every different line once, with its first place (order) among all parts: sort by it for the merged file."""
    return parts.where(F.length(F.trim(line)) > 0).groupBy(line).agg(F.min(F.struct(*order)).alias("place"))


def cached_or_computed(wanted: DataFrame, cache: DataFrame, key: str, value: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, value, computed) of everything wanted: from the cache where it is there, computed otherwise.

    ``compute`` gets only the rows that the cache lacks; a key that it does not resolve fails the query.
    """
    cached = wanted.select(key).join(cache.select(key, value), key)
    missing = wanted.join(cache.select(key), key, "left_anti")
    made = missing.select(key).join(compute(missing).select(key, value), key, "left")
    unresolved = F.raise_error(F.concat(F.lit("unresolved: "), F.col(key).cast("string")))
    made = made.withColumn(value, F.when(F.col(value).isNull(), unresolved.cast(dict(made.dtypes)[value])).otherwise(F.col(value)))
    return cached.withColumn("computed", F.lit(False)).unionByName(made.withColumn("computed", F.lit(True)))


class Unsupported(RuntimeError):
    """A run asks for what its machine does not have."""


#: Kinds of numbers and the capability that each needs (0: any machine); fixed values.
KINDS = {"float32": 0.0, "float16": 0.0, "bfloat16": 8.0}


def resolve_kind(requested: str, capability: float | None) -> str:
    """The kind of numbers to compute with; never silently another than the one that was asked for.

    Without an accelerator (no capability) float16 is computed as float32.
    """
    if requested not in KINDS:
        raise ValueError(f"unknown kind of numbers {requested!r}; one of {sorted(KINDS)} is expected")
    if capability is not None and capability < KINDS[requested]:
        raise Unsupported(f"{requested} needs capability {KINDS[requested]}, this machine has {capability}")
    return "float32" if requested == "float16" and capability is None else requested


def checked_kinds(models: DataFrame, requested: str, capability: str) -> DataFrame:
    """``models`` with the column resolved, by ``resolve_kind`` as an expression; the first that is not supported fails the query."""
    kind, has = F.col(requested), F.col(capability)
    least = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])
    known = F.coalesce(kind.isin(list(KINDS)), F.lit(False))
    bad = F.when(~known, F.concat(F.lit("unknown kind of numbers "), F.coalesce(kind, F.lit("null")))).when(has < F.element_at(least, kind), F.concat(kind, F.lit(" is not supported")))
    value = F.when((kind == "float16") & has.isNull(), F.lit("float32")).otherwise(kind)
    return models.withColumn("resolved", F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(value))


def fingerprint() -> dict[str, str]:
    """What the records of a run say about where they were made."""
    return {"host": platform.node(), "platform": platform.platform(), "python": platform.python_version(), "spark": pyspark.__version__, "numpy": numpy.__version__, "pyarrow": pyarrow.__version__}


def with_fingerprint(records: DataFrame, env: dict[str, str] | None = None) -> DataFrame:
    """``records`` with the struct env, constants of the plan."""
    return records.withColumn("env", F.struct(*[F.lit(v).alias(k) for k, v in sorted((env or fingerprint()).items())]))


class Registry:
    """Named implementations (generators, codecs, embedders); asking for an unknown name tells the known ones."""

    def __init__(self, kind: str, **known: Callable):
        self.kind, self.known = kind, dict(known)

    def add(self, name: str, make: Callable) -> None:
        self.known[name] = make

    def __getitem__(self, name: str) -> Callable:
        if name not in self.known:
            raise KeyError(f"no {self.kind} {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[name]


def quantiser(bits: int) -> Callable[[Column], Column]:
    """A codec of vectors or samples in [-1, 1]: values rounded to so many bits and back."""
    steps = float(2 ** (bits - 1))
    return lambda x: F.transform(x, lambda z: F.round(z * steps, 0) / steps)


#: Round trips by name, as column functions over an array of samples or components.
CODECS = Registry("codec", identity=lambda x: x, q4=quantiser(4), q8=quantiser(8))
#: Embedders by name: from an array of samples to a vector.
EMBEDDERS = Registry("embedder", moments=lambda x: F.array(F.aggregate(x, F.lit(0.0), lambda t, v: t + v) / F.size(x), F.array_max(x), F.array_min(x)), identity=lambda x: x)
