"""Operator 9: embedding near-duplicates by int8 tile products with error bounds.

Vectors are normalised in double precision and quantised to int8 with a scale of
their own, u = s q + e; the residual's norm |e| is kept. For two of them

    u . v <= s s' (q . q') + |e| + (1 + |e|) |e'|

holds, so a pair whose bound is below the threshold is no link. Products of int8
tiles are exact integers (as float32 matrix products, below 2**24); only pairs
whose bound reaches the threshold are computed again in double precision.

Equal vectors form one class, which takes part once, with its size, under a number
of its own (two classes may hold the same vec_id). Classes are dealt to tiles of
bounded size by a hash; every pair of tiles is one group of two binary rows, in the
precision that the column has. Tiles are sorted before they are gathered, so a task
holds one of them, however many it makes. A tile pair gives sums of links per class and a spanning star of
each connected set, at most one row for each of its classes, so a group of copies
never turns into all of its pairs. Every vector meets every tile: the work grows
with the square of the number of different vectors.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite
component links with nothing and is kept; vectors of different length do not
link; rows of equal vec_id are rows of their own, each with its own vector's links; a
null vec_id links with nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .components import components, contract
from .scratch import materialise

#: Vectors of a tile, about; rows of a tile multiplied at a time.
TILE, ROWS = 4096, 512
#: Slack for rounding in float32 scaling and in the norms.
SLACK = 2e-6

_ROW = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("k0", pa.int64()), ("k1", pa.int64()), ("vec", pa.binary())])


def _rows(kind: str):
    return lambda batches: _read(batches, kind)


def _read(batches, kind: str):
    """vec_id and, for a usable vector, its length, a 128-bit digest and its bytes, as floats of ``kind``."""
    width = np.dtype(kind).itemsize
    for batch in batches:
        ids, column = batch.column("vec_id"), batch.column("embedding").cast(pa.list_(pa.float64()))
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        values = column.values
        flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
        real = column.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
        dims, k0, k1, vecs = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
        for i in range(n):
            v = flat[offsets[i] : offsets[i + 1]]
            if not real[i] or not len(v) or not np.isfinite(v).all():
                continue
            top = np.abs(v).max()
            if top == 0:
                continue
            dims[i], vecs[i] = len(v), (v + 0.0).astype(kind).tobytes()
        good = np.flatnonzero(dims)
        if len(good):
            raw = np.frombuffer(b"".join([vecs[i] for i in good]), np.uint8)
            ends = np.cumsum(dims[good].astype(np.int64) * width)
            starts = ends - dims[good].astype(np.int64) * width
            k0[good] = bytescan.span_hashes(raw, starts, ends).view(np.int64)
            k1[good] = bytescan.span_hashes(raw[::-1].copy(), len(raw) - ends, len(raw) - starts).view(np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(dims), pa.array(k0), pa.array(k1), pa.array(vecs, pa.binary())], schema=_ROW)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (double), their int8 form, scales and the norms of what the form lacks."""
    v = v / np.abs(v).max(axis=1, keepdims=True)  # before squaring: no overflow or underflow
    unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    lack = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1))
    return unit, q.astype(np.int8), scale, lack


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool):
    """Row and column numbers of all pairs with cosine >= threshold; of one tile, each pair once."""
    ua, qa, sa, ea = quantise(a)
    ub, qb, sb, eb = (ua, qa, sa, ea) if same else quantise(b)
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right, scale_b = np.ascontiguousarray(qb.T.astype(kind)), sb.astype(kind)
    most = float(eb.max())
    rows, cols = [], []
    for lo in range(0, len(a), ROWS):
        hi = min(len(a), lo + ROWS)
        bound = (threshold - ea[lo:hi] - (1 + ea[lo:hi]) * most - SLACK) / sa[lo:hi]
        product = qa[lo:hi].astype(kind) @ right
        product *= scale_b
        r, c = np.nonzero(product >= bound[:, None].astype(kind))
        if same:
            once = c > r + lo
            r, c = r[once], c[once]
        for at in range(0, len(r), 1 << 17):
            i, j = r[at : at + (1 << 17)] + lo, c[at : at + (1 << 17)]
            hit = np.einsum("ij,ij->i", ua[i], ub[j]) >= threshold
            rows.append(i[hit])
            cols.append(j[hit])
    none = np.empty(0, np.int64)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (none, none)


_BLOB = pa.schema([("dim", pa.int32()), ("tile", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("vecs", pa.binary())])


def _tiles(batches):
    """One binary row for each tile; rows come in order of tiles."""
    now, held = None, ([], [], [])

    def out():
        return pa.RecordBatch.from_arrays([
            pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([np.array(held[0], "<i8").tobytes()], pa.binary()),
            pa.array([np.array(held[1], "<i8").tobytes()], pa.binary()), pa.array([b"".join(held[2])], pa.binary())], schema=_BLOB)

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        for dim, tile, cid, size, vec in zip(*cols):
            if (dim, tile) != now:
                if now is not None:
                    yield out()
                now, held = (dim, tile), ([], [], [])
            held[0].append(cid), held[1].append(size), held[2].append(vec)
    if now is not None:
        yield out()


_OUT = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])


def _meet(threshold: float, kind_of: str):
    def read(row):
        ids, sizes = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<i8")
        return ids, sizes, np.frombuffer(row["vecs"], kind_of).astype(np.float64).reshape(len(ids), row["dim"])

    def run(batches):
        first = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["side"] == 0:
                    first = row
                    if row["i"] != row["j"]:
                        continue
                elif first is None or (first["dim"], first["i"], first["j"]) != (row["dim"], row["i"], row["j"]):
                    continue  # a tile without rows
                ids_a, sizes_a, a = read(first)
                same = row["i"] == row["j"]
                ids_b, sizes_b, b = (ids_a, sizes_a, a) if same else read(row)
                r, c = tile_links(a, b, threshold, same)
                if not len(r):
                    continue
                more_a, more_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
                np.add.at(more_a, r, sizes_b[c])
                np.add.at(more_a if same else more_b, c, sizes_a[r])
                low, high = contract(ids_a[r], ids_b[c])
                x, y = np.flatnonzero(more_a), np.flatnonzero(more_b)
                kind = np.concatenate([np.zeros(len(x) + len(y), np.int8), np.ones(len(low), np.int8)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(kind), pa.array(np.concatenate([ids_a[x], ids_b[y], low])),
                    pa.array(np.concatenate([more_a[x], more_b[y], high]))], schema=_OUT)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    kind = "<f4" if vectors.select("embedding").dtypes[0][1] == "array<float>" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    scanned = materialise(rows.mapInArrow(_rows(kind), "vec_id long, dim int, k0 long, k1 long, vec binary"), "vectors")
    classes = scanned.where("dim > 0").groupBy("dim", "k0", "k1").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("vec").alias("vec"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")

    # one row for each length of vectors: k different lengths take k * k / 2 components at least
    per_dim = classes.groupBy("dim").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    dealt = classes.join(F.broadcast(per_dim), "dim").select("dim", F.pmod(F.xxhash64("cid"), "tiles").alias("tile"), "cid", "size", "vec")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blobs = dealt.repartition(n, "dim", "tile").sortWithinPartitions("dim", "tile").mapInArrow(_tiles, "dim int, tile long, ids binary, sizes binary, vecs binary")
    blobs = materialise(blobs, "tiles").join(F.broadcast(per_dim), "dim")
    left = blobs.select("dim", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j"), F.lit(0).alias("side"), "ids", "sizes", "vecs")
    right = blobs.where("tile > 0").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tile") - 1)).alias("i"), F.col("tile").alias("j"), F.lit(1).alias("side"), "ids", "sizes", "vecs")
    met = left.unionByName(right).repartition(n, "dim", "i", "j").sortWithinPartitions("dim", "i", "j", "side")
    found = materialise(met.mapInArrow(_meet(threshold, kind), "kind byte, a long, b long"), "vector-links")

    more = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("more"))
    part = materialise(components(found.where("kind = 1").select("a", "b")), "vector-components")
    lowest = part.join(classes.select("cid", "rep"), F.col("node") == F.col("cid")).groupBy("component").agg(F.min("rep").alias("low"))
    part = part.join(lowest, "component").select("node", "low")
    labels = (classes.select("dim", "k0", "k1", "cid", "rep", "size").join(more, F.col("cid") == F.col("a"), "left").join(part, F.col("cid") == F.col("node"), "left")
              .select("dim", "k0", "k1", (F.coalesce("more", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("low", "rep").alias("component")))
    out = scanned.drop("vec").join(labels, ["dim", "k0", "k1"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
