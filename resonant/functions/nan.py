"""NaN-safe column helpers: NaN means "undefined metric" and never passes a comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def above(a: Column, b) -> Column:
    """a > b, false where either is NaN or null (Spark itself sorts NaN above all numbers)."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & (a > b), F.lit(False))


def at_most(a: Column, b) -> Column:
    """a <= b, false where either is NaN or null."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & (a <= b), F.lit(False))


def at_least(a: Column, b) -> Column:
    """a >= b, false where either is NaN or null."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & (a >= b), F.lit(False))


def or_nan(c: Column) -> Column:
    """A missing nested field as NaN."""
    return F.coalesce(c.cast("double"), F.lit(NAN))


def dbfs(c: Column) -> Column:
    """Decibels relative to full scale, with a floor of -240."""
    return F.lit(20.0) * F.log10(F.greatest(c.cast("double"), F.lit(1e-12)))
