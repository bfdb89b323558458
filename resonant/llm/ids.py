"""Keeping or dropping the documents of an id table without shuffling the other texts.

Both directions first look the document up in a bitmap of the ids, sized by their
number: 16 bits for each, 2**28 (32 MB) at most, which is why it may be broadcast.
Only rows whose bit is set go through the exact join. Where the ids are too many
for such a map to tell anything, all rows go through the join.

The input's columns travel in one struct, so none of its names can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

#: The bits of the map are 2 to the power of these numbers, at least and at most.
LEAST, MOST = 16, 28


def spot(column: str, bits: int) -> Column:
    """The bit of a value."""
    return F.pmod(F.xxhash64(column), F.lit(1 << bits))


def bits_for(n: int) -> int | None:
    """The logarithm of the size of a map of n values; None where it would be too full."""
    bits = max(LEAST, (16 * n).bit_length())
    return min(bits, MOST) if bits <= MOST + 3 else None


def bitmap(values: DataFrame, column: str, bits: int) -> DataFrame:
    """(part, bits) of the map of a column's values."""
    at = values.select(spot(column, bits).alias("p"))
    return materialise(at.groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")), "bits")


def hits(rows: DataFrame, column: str, found: DataFrame, bits: int) -> DataFrame:
    """``rows`` (without columns p, part, bits and hit) with the column hit, whether the bit of ``column`` is set."""
    hit = F.expr("shiftright(conv(hex(substring(bits, cast(bitmap_bit_position(p) div 8 as int) + 1, 1)), 16, 10), cast(bitmap_bit_position(p) % 8 as int)) & 1 = 1")
    met = rows.withColumn("p", spot(column, bits)).join(F.broadcast(found), F.bitmap_bucket_number("p") == F.col("part"), "left")
    return met.withColumn("hit", F.coalesce(hit, F.lit(False))).drop("p", "part", "bits")


def _parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, k, hit) of every document, and the different ids (i)."""
    wanted = materialise(ids.select(F.col("doc_id").alias("i")).where("i is not null").distinct(), "ids")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("k"))
    bits = bits_for(wanted.count())
    return rows.withColumn("hit", F.lit(True)) if bits is None else hits(rows, "k", bitmap(wanted, "i", bits), bits), wanted


def only_needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (doc_id)."""
    rows, wanted = _parted(docs, ids)
    return rows.where("hit").join(wanted, F.col("k") == F.col("i"), "left_semi").select("row.*")


def maybe_needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id may be in ``ids``: all that are, and a few more, before an exact join."""
    rows, _ = _parted(docs, ids)
    return rows.where("hit").select("row.*")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids`` (doc_id); a null doc_id stays."""
    rows, wanted = _parted(docs, ids)
    rest = rows.where("hit").join(wanted, F.col("k") == F.col("i"), "left_anti").select("row")
    return rows.where("not hit").select("row").unionByName(rest).select("row.*")
