"""Confidence intervals as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nan import NAN


def z_quantile(level: float = 0.95) -> float:
    return NormalDist().inv_cdf(0.5 + level / 2)


def _t_cdf(t: float, df: int) -> float:
    """Student's distribution function, by its finite series for whole degrees of freedom."""
    theta = math.atan2(t, math.sqrt(df))
    s, c = math.sin(theta), math.cos(theta)
    if df % 2:
        total, term = 0.0, c
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= c * c * 2 * k / (2 * k + 1)
        return 0.5 + (theta + s * total) / math.pi
    total, term = 0.0, 1.0
    for k in range(1, df // 2 + 1):
        total += term
        term *= c * c * (2 * k - 1) / (2 * k)
    return 0.5 + s * total / 2


def t_quantile(df: int, level: float = 0.95) -> float:
    """The two-sided quantile, by bisection."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _t_cdf(mid, df) < 0.5 + level / 2 else (lo, mid)
    return (lo + hi) / 2


#: Quantiles shipped as constants; beyond, an expansion in 1 / degrees (right to six digits).
T_DEGREES = 30


def t_column(df: Column, level: float = 0.95) -> Column:
    table = F.array(*[F.lit(t_quantile(d, level)) for d in range(1, T_DEGREES + 1)])
    z, v = z_quantile(level), df.cast("double")
    # terms of Fisher's expansion of Student's quantile about the normal one; fixed coefficients
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    beyond = F.lit(z) + terms[0] / v + terms[1] / (v * v) + terms[2] / (v * v * v)
    return F.when(df.between(1, T_DEGREES), F.get(table, df.cast("int") - 1)).when(df > T_DEGREES, beyond)


def wilson(successes: Column, n: Column, level: float = 0.95) -> Column:
    """struct(p, ci_lo, ci_hi, n): the Wilson interval, NaN for n = 0."""
    z, k, m = F.lit(z_quantile(level)), successes.cast("double"), n.cast("double")
    p = k / m
    mid = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    value = lambda c: F.when(m > 0, c).otherwise(F.lit(NAN))
    return F.struct(value(p).alias("p"), value(mid - half).alias("ci_lo"), value(mid + half).alias("ci_hi"), n.cast("long").alias("n"))


def between_set(values: Column, level: float = 0.95) -> Column:
    """Aggregate: struct(mean, se, ci_lo, ci_hi, k) of set values; one set gives a point."""
    k, mean = F.count(values), F.avg(values)
    se = F.coalesce(F.stddev_samp(values) / F.sqrt(k.cast("double")), F.lit(0.0))
    half = F.when(k > 1, t_column(k - 1, level) * se).otherwise(0.0)
    return F.struct(mean.alias("mean"), se.alias("se"), (mean - half).alias("ci_lo"), (mean + half).alias("ci_hi"), k.alias("k"))


def combined(between_lo: Column, between_hi: Column, boot_lo: Column, boot_hi: Column) -> Column:
    """struct(ci_lo, ci_hi, dominant_source): the envelope of two intervals and the wider source (between on a tie)."""
    wider = F.when(boot_hi - boot_lo > between_hi - between_lo, "bootstrap").otherwise("between_set")
    return F.struct(F.least(between_lo, boot_lo).alias("ci_lo"), F.greatest(between_hi, boot_hi).alias("ci_hi"), wider.alias("dominant_source"))


def overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return ~((hi_a < lo_b) | (hi_b < lo_a))


def fmt(point: Column, lo: Column, hi: Column, digits: int = 3) -> Column:
    """'p [lo, hi]', or a dash where the point is undefined."""
    text = F.format_string(f"%.{digits}f [%.{digits}f, %.{digits}f]", point, lo, hi)
    return F.when(point.isNotNull() & ~F.isnan(point), text).otherwise(F.lit("—"))
