"""Connected components of an edge table, distributed.

Edges are first contracted inside each task (a spanning star for every set of
nodes that the task's edges connect), then large-star and small-star steps run
in turn (Kiveris et al., "Connected Components in MapReduce and Beyond") until
the edges no longer change, or are at most ``local`` (16 MB), which one task contracts
as well; the result is the same. Both steps are minima per node, so a node with very many edges is
pre-aggregated before each shuffle. Every round is written to the shared folder;
nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Edges contracted at a time (16 MB), and left for one task at most.
_CHUNK = 1_000_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest connected node, node) for each node that is not itself the smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            break
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[child]], nodes[child]


def _contract(batches):
    held, n = [], 0

    def out():
        a, b = contract(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGE)

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
        if n >= _CHUNK:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def contracted(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contract, "a long, b long")


def components(edges: DataFrame, local: int = _CHUNK) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long; no nulls): its smallest connected node."""
    now = materialise(contracted(edges.where("a <> b")).where("a <> b"), "edges")
    digest = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = digest(now)
    while True:  # each round lowers some node's neighbour until none can be lowered
        if seen[0] <= local:
            now = materialise(contracted(now.coalesce(1)), "edges")
            break
        # a < b throughout: large star, then small star
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x < y")
        now = materialise(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        last, seen = seen, digest(now)
        if seen == last:
            break
    child = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return child.union(now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component")))
