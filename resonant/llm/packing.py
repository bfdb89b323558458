"""Operator 2: packing token sequences by Karmarkar-Karp multiway differencing.

Each task streams its documents. A document's ids are cut every ``capacity``
ids: full windows leave at once. What remains of each document is cut into
pieces of ``piece`` ids at most and gathered until a batch holds about
``batch`` ids; the batch then goes to ``ceil(ids / capacity)`` windows. Every
piece starts as a partial partition with one filled window; the two partial
partitions of greatest imbalance are merged, the fullest window of one with the
emptiest of the other, until one is left. If its largest window exceeds the
capacity, the number of windows rises by one and the batch is parted again.

No text moves between tasks, and a task holds one batch of pieces, however many
documents share a source. Windows get the task's number and a count within the
task as sequence_id, so a repeated task gives the same rows.

Defined cases: a null text is an empty one (one piece with the end id); repeated
rows are packed each; a null doc_id stays null; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan, tokens
from .workers import returning

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, padded_length long, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_length", pa.int64()), ("ids", pa.binary())])


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The sizes' indices in k windows of nearly equal sums.

    A partial partition is its non-empty windows in descending order of sum; the
    others of its k windows are empty. Ties go to the earlier one.
    """
    if k <= 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(k - 1)]
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:  # the smallest `over` windows of each meet, small with large
            a_free, a_met = a[: len(a) - over], a[len(a) - over :]
            b_free, b_met = b[: len(b) - over], b[len(b) - over :]
            merged = a_free + b_free + [(x + y, p + q) for (x, p), (y, q) in zip(a_met, reversed(b_met))]
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[0][0], turn, merged))
        turn += 1
    windows = [w for _, w in heap[0][2]]
    return windows + [[] for _ in range(k - len(windows))]


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows within the capacity; their number rises until all are."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        k += 1


def padded(used: int, capacity: int) -> int:
    """A window's length with padding: the capacity, or its own length where that is a power of two."""
    return used if used & (used - 1) == 0 else capacity


def _packer(tokenizer: str, end_id: int, capacity: int, piece: int, batch_ids: int):
    def run(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        encoder = tokens.encoder(tokenizer)
        waiting: list[tuple] = []
        held = 0
        out: list[tuple] = []

        def flush():
            nonlocal waiting, held, sequence
            for window in fill([p[2] for p in waiting], capacity):
                at, used = 0, sum(waiting[i][2] for i in window)
                for i in sorted(window):
                    name, start, length, total, raw = waiting[i]
                    out.append((name, start, length, total, sequence, at, padded(used, capacity), raw))
                    at += length
                sequence += 1
            waiting, held = [], 0

        def rows():
            nonlocal out
            got, out = out, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), _ARROW)], schema=_ARROW)

        tail = np.array([end_id], np.uint32)
        for batch in batches:
            data, offsets = bytescan.text_buffer(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for i, j in bytescan.pieces(offsets):
                ids, bounds = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k in range(j - i):
                    own = np.concatenate([ids[bounds[k] : bounds[k + 1]], tail]).astype("<u4")
                    n, raw, name, at = len(own), own.tobytes(), names[i + k], 0
                    while n - at >= capacity:
                        out.append((name, at, capacity, n, sequence, 0, capacity, raw[at * 4 : (at + capacity) * 4]))
                        at, sequence = at + capacity, sequence + 1
                    while at < n:
                        length = min(piece, n - at)
                        waiting.append((name, at, length, n, raw[at * 4 : (at + length) * 4]))
                        at, held = at + length, held + length
                    if held >= batch_ids:
                        flush()
                    if len(out) >= 2000:
                        yield rows()
        if waiting:
            flush()
        if out:
            yield rows()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, piece: int = 512, batch_ids: int = 1 << 20) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text), with their place in a sequence and their ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(returning(_packer(tokenizer, end_id, capacity, piece, batch_ids), encodes=True), SCHEMA)
