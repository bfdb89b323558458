"""Bootstrap by weights: every observation draws, where it lies, how often it occurs in each resample.

The weights are Poisson of mean one, from MD5 of (seed, names, number of the resample),
so no observation is moved or numbered: the sums of a resample are pre-aggregated in
each task, and what is shuffled is one row for each task, group and resample.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The cumulated Poisson probabilities as eight hexadecimal digits: a draw has the weight of as many as it reaches.
STEPS = [f"{math.floor(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32):08x}" for k in range(11)]
#: Draws of one digest.
_DRAWS = 4

Statistic = Callable[[Column, Column], Column]


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def weighted_percentile(q: float) -> Statistic:
    """The exact percentile of a resample."""
    return lambda value, weight: F.percentile(value, F.lit(q), weight)


def weight_rows(rows: DataFrame, names: list[str], resamples: int, seed: int = 0) -> DataFrame:
    """``rows`` once for each resample b that they occur in, with their weight w; ``names`` identify an observation."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(n).cast("string") for n in names], F.col("chunk")))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // _DRAWS) - 1)))).withColumn("digest", digest)
    weight = lambda i: reduce(lambda a, b: a + b, [(F.substring("digest", 8 * i + 1, 8) >= s).cast("int") for s in STEPS])
    draws = F.array(*[F.struct((F.col("chunk") * _DRAWS + i).alias("b"), weight(i).alias("w")) for i in range(_DRAWS)])
    drawn = rows.withColumn("draw", F.explode(draws)).where(f"draw.w > 0 and draw.b < {resamples}")
    return drawn.select(*[c for c in rows.columns if c not in ("chunk", "digest")], "draw.b", "draw.w")


def resampled(values: DataFrame, group: list[str], key: list[str], statistics: dict[str, Column], resamples: int, seed: int = 0) -> DataFrame:
    """(group..., b, one column for each statistic, an aggregate over the column w)."""
    drawn = weight_rows(values, [*group, *key], resamples, seed)
    return drawn.groupBy(*group, "b").agg(*[c.alias(n) for n, c in statistics.items()])


def bootstrap_ci(values: DataFrame, group: list[str], key: list[str], value: str = "v", statistic: Statistic = weighted_mean, resamples: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(group..., point, ci_lo, ci_hi, boot_std, n_resamples, n_observations) of any statistic of a column.

    Without groups, no observation at all is an error.
    """
    boot = resampled(values, group, key, {"m": statistic(F.col(value), F.col("w"))}, resamples, seed)
    ci = boot.groupBy(*group).agg(
        F.percentile("m", F.lit((1 - level) / 2)).alias("ci_lo"), F.percentile("m", F.lit((1 + level) / 2)).alias("ci_hi"), F.stddev_pop("m").alias("boot_std"), F.count("*").alias("n_resamples"))
    n = F.count("*")
    if not group:
        n = F.when(n == 0, F.raise_error("no observations").cast("long")).otherwise(n)
    point = values.groupBy(*group).agg(statistic(F.col(value), F.lit(1)).alias("point"), n.alias("n_observations"))
    return ci.join(point, group) if group else point.crossJoin(ci)


def weights_sql(values: str, group: str, key: str, resamples: int, seed: int = 0) -> str:
    """The rows of ``weight_rows`` over (group, key, ...) in SQL."""
    digits = f"md5('{seed}|' || {group} || '|' || {key} || '|' || (b // {_DRAWS}))[8 * (b % {_DRAWS}) + 1 : 8 * (b % {_DRAWS}) + 8]"
    steps = " + ".join(f"CAST(h >= '{s}' AS INT)" for s in STEPS)
    return f"SELECT * FROM (SELECT *, {steps} AS w FROM (SELECT v.*, b, {digits} AS h FROM ({values}) v, range({resamples}) r(b))) WHERE w > 0"
