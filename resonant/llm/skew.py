"""Joins by keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more than one in so many rows is heavy; so fewer than this number of keys are.
HEAVY = 500


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], total: int, size: str = "size") -> DataFrame:
    """Inner join of ``rows`` with one row for each key, of which ``size`` is the number of its rows (a column that goes).

    ``total`` is the sum of all sizes that matter. Rows of heavy keys stay where they
    are and meet their key's row by broadcast, of fewer than HEAVY rows whatever the
    input; the others are dealt by key, none of which can fill a task.
    """
    heavy = F.broadcast(per_key.where(F.col(size) * HEAVY > total))
    light = per_key.where(F.col(size) * HEAVY <= total)
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(light.drop(size), keys)
    return rows.join(heavy.drop(size), keys).unionByName(rest)
