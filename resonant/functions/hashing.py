"""Deterministic hashing: the same shard, order or sample index in every run and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_mod(c: Column, n: int) -> Column:
    """The 128-bit MD5 number modulo n, without leaving 64-bit arithmetic.

    The digest is read in eight-digit parts, each a 32-bit number; the remainder
    is carried from part to part, so n may go up to 2**31.
    """
    digest, out = F.md5(c.cast("binary")), F.lit(0).cast("long")
    for at in range(1, 33, 8):
        part = F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
        out = F.pmod(out * F.lit(4294967296 % n) + part, F.lit(n).cast("long"))
    return out


def hash_index(seed: int, n: Column, *parts: Column) -> Column:
    """A pseudo-random index in [0, n) from a seed and key parts."""
    key = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), n.cast("long"))


def hash_order(seed: int, *parts: Column) -> Column:
    """A key whose order is a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
