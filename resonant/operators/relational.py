"""Relational operators of an evaluation run: planning, resuming, ingesting, sharding and sampling.

All are plain DataFrame compositions: one shuffle on the key at most, with
map-side aggregation wherever an aggregate is enough (no group is collected).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_order, md5_mod


def plan_runs(models: DataFrame, durations: DataFrame, prompts: DataFrame, replicates: Column, tracks: int) -> DataFrame:
    """Every model, duration, prompt, set and track of a factorial plan.

    The dimensions are cross-joined (they are configuration, not data) and the
    sets and tracks are generated, so no row beyond the result is made.
    """
    cells = models.crossJoin(F.broadcast(durations)).withColumn("k", replicates.cast("int")).where("k > 0")
    sets = cells.withColumn("set_idx", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return sets.crossJoin(F.broadcast(prompts)).withColumn("track_idx", F.explode(F.sequence(F.lit(0), F.lit(tracks - 1))))


def make_seed(base: int, set_idx: Column, prompt_idx: Column, track_idx: Column) -> Column:
    """A seed that is unique within a plan of fewer than 100 prompts and 1000 tracks."""
    return F.lit(base).cast("long") + 100000 * set_idx.cast("long") + 1000 * prompt_idx.cast("long") + track_idx.cast("long")


def replicates_for(model: Column, duration: Column, full: Sequence[str], reduced: Sequence[str], reduced_durations: Sequence[float], full_k: int, reduced_k: int, default_k: int) -> Column:
    """K of a cell: reduced where both model and duration are, else full for a full model, else the default."""
    return (F.when(model.isin(list(reduced)) & duration.isin(list(reduced_durations)), reduced_k)
            .when(model.isin(list(full)), full_k).otherwise(default_k))


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The last row of each key. An aggregate, not a window: rows of a hot key are reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return picked.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def pending(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What of a plan is not done yet."""
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")


def first_k(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group (a ranking whose limit Catalyst applies before and after the shuffle)."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def shard_of(key: Column, n: int) -> Column:
    return md5_mod(key, n)


def sample_rows(rows: DataFrame, n: int, seed: int, key: str, order: Sequence[str]) -> DataFrame:
    """n rows without replacement, by seeded hash, back in plan order."""
    return rows.orderBy(hash_order(seed, F.col(key)), key).limit(n).orderBy(*order)


def cap_per_group(rows: DataFrame, group: str, key: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of each group, chosen by seeded hash."""
    return first_k(rows, [group], [hash_order(seed, F.col(key)), F.col(key)], most)


def union_exact(*parts: DataFrame) -> DataFrame:
    """The rows of all parts, equal ones once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates()


def half_open_join(points: DataFrame, spans: DataFrame, key: Sequence[str], at: str, lo: str, hi: str) -> DataFrame:
    """Points with lo <= at < hi of the spans of their key."""
    return points.join(spans, list(key)).where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi)))
