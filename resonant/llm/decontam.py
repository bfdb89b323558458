"""Operator 10: benchmark decontamination by spaced seeds, joined on their hashes.

Words are runs of letters and digits in lower case, so punctuation does not
matter. A document is laid against an item without gaps, and the best stretch (one
for an equal word, minus two for another) must hold ``least`` equal words (or
``share`` of a shorter item's) with ``identity`` of its words equal.

Seeds are spaced: each of an item's fixed ``MASKS`` takes some places of a window and
ignores those between, and the hash of the words that it takes at every place of a
document is joined to those of the benchmark. A stretch of n equal and e other words
holds n + e - span + 1 windows of a mask, and another word falls on as many of them as
the mask takes places, so its alignment has at least n + e - span + 1 - weight * e hits.
What is accepted bounds n and e; an alignment is verified when it has the least number
of hits that any accepted stretch of its item can have (``seeds_for``), and none that
verification accepts is left out.

The benchmark is the query set: it is sent to the tasks in blocks of about
``BLOCK_WORDS`` words or ``BLOCK_BYTES`` bytes (an item is never cut), each of which is
run against all documents, so its size is bounded whatever the benchmark's. Documents
stream through once per block; nothing is shuffled.

Defined cases: a null or empty text or item matches nothing, nor does an item of
fewer than ``SHORTEST`` words; equal items and repeated rows match each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .workers import returning

SHORTEST = 6
#: Places that each mask takes, the rest up to its last is ignored; an item takes the first row that cannot miss it.
MASKS = [[(0, 1, 3), (0, 2, 3)], [(0, 2)], [(0,)]]
BLOCK_WORDS, BLOCK_BYTES = 500_000, 1 << 23
#: Pairs of a place and a seed at a time, to bound memory.
PAIRS = 1 << 21
_FILTER_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("item_start", pa.int32()), ("n_words", pa.int32()), ("n_equal", pa.int32())])


def _words(data: np.ndarray, offsets: np.ndarray):
    low = bytescan.lower_latin(data)
    starts, ends, bounds = bytescan.word_spans(low, offsets, bytescan.ALPHANUMERIC)
    return bytescan.span_hashes(low, starts, ends), bounds, starts, ends


def seeds_for(words: int, least: int, share: float, identity: float) -> tuple[int, int]:
    """The row of MASKS for an item of so many words, and the hits in all of an alignment that may be accepted."""
    fewest = max(1, math.ceil(min(least, np.ceil(share * words))))
    # of each n, the greatest e that may be accepted leaves the fewest hits
    able = [(n, min(words - n, int(n / identity - n + 1e-9))) for n in range(fewest, words + 1)]
    for row, masks in enumerate(MASKS):
        hits = min((sum(max(0, n + e - mask[-1] - len(mask) * e) for mask in masks) for n, e in able), default=0)
        if hits > 0:
            return row, hits
    return len(MASKS) - 1, 1  # nothing of the item can be accepted


def _seeds(words: np.ndarray, row: int, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of what the mask takes at each place that its window fits in."""
    n = max(0, len(words) - mask[-1])
    h = np.full(n, np.uint64(1000 + 10 * row + MASKS[row].index(mask)), np.uint64)
    for place in mask if n else ():
        h = bytescan.mix(h * _BASE + words[place : place + n])
    return h


class Index:
    """The seeds of some benchmark items, sorted by hash."""

    def __init__(self, ids: list, texts: list, least: int = 12, share: float = 0.8, identity: float = 0.8):
        data, offsets = bytescan.text_buffer(pa.array(texts, pa.binary()))
        self.words, self.bounds, _, _ = _words(data, offsets)
        self.ids = ids
        self.needed = np.ones(len(ids), np.int64)
        plans: dict[int, tuple[int, int]] = {}
        hashes, items, places = [], [], []
        for i in range(len(ids)):
            own = self.words[self.bounds[i] : self.bounds[i + 1]]
            if len(own) < SHORTEST:
                continue
            if len(own) not in plans:
                plans[len(own)] = seeds_for(len(own), least, share, identity)
            row, self.needed[i] = plans[len(own)]
            for mask in MASKS[row]:
                h = _seeds(own, row, mask)
                hashes.append(h)
                items.append(np.full(len(h), i))
                places.append(np.arange(len(h)))
        self.masks = [(row, mask) for row in sorted({row for row, _ in plans.values()}) for mask in MASKS[row]]
        none = np.empty(0, np.int64)
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.items = (np.concatenate(items) if items else none)[order]
        self.places = (np.concatenate(places) if places else none)[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, h: np.ndarray):
        """Places in ``h`` and the seeds they meet, all pairs, about PAIRS at a time."""
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        for block in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1) if len(at) else ():
            m = n[block]
            yield np.repeat(at[block], m), np.repeat(lo[block] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(int(m.sum()))

    def alignments(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """Document, item and the place where the item's first word lies, wherever the hits suffice."""
        width, docs = len(words) + len(self.words) + 1, len(bounds)
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for row, mask in self.masks:
            for at, seed in self.hits(_seeds(words, row, mask)):
                doc = np.searchsorted(bounds, at, "right") - 1
                key, n = np.unique((self.items[seed] * docs + doc) * width + at - self.places[seed] + len(self.words), return_counts=True)
                keys, inverse = np.unique(np.concatenate([keys, key]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([counts, n])).astype(np.int64)
        keys = keys[counts >= self.needed[keys // (width * docs)]]
        return list(zip((keys // width % docs).tolist(), (keys // (width * docs)).tolist(), (keys % width - len(self.words)).tolist()))


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """The stretch of greatest score, one for each equal word and minus two for another; the first of equals."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.argmax(total[: end + 1] == low[end])) if end else 0, end


def _search(sent, least: int, share: float, identity: float):
    def run(batches):
        index = sent.value
        for batch in batches:
            data, offsets = bytescan.text_buffer(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            rows = []
            for i, j in bytescan.pieces(offsets):
                words, bounds, starts, ends = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                best: dict[tuple, tuple] = {}
                for d, item, begin in index.alignments(words, bounds):  # the item's first word lies at `begin`
                    own = index.words[index.bounds[item] : index.bounds[item + 1]]
                    lo, hi = max(begin, bounds[d]), min(begin + len(own), bounds[d + 1])
                    equal = words[lo:hi] == own[lo - begin : hi - begin]
                    a, b = best_stretch(equal)
                    n = int(equal[a:b].sum())
                    if b > a and n >= min(least, np.ceil(share * len(own))) and n >= identity * (b - a):
                        row = (n, -(b - a), -lo - a, int(starts[lo + a] + offsets[i] - offsets[i + d]), int(ends[lo + b - 1] + offsets[i] - offsets[i + d]), lo + a - begin)
                        if row > best.get((d, item), (-1,)):
                            best[d, item] = row
                rows += [(names[i + d], index.ids[item], r[3], r[4], r[5], -r[1], r[0]) for (d, item), r in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_OUT), _OUT)], schema=_OUT)

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 12, share: float = 0.8, identity: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, start_byte, end_byte (in the text), item_start, n_words and n_equal: the best stretch of each document and item that overlap."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    out, ids, texts, words, size = None, [], [], 0, 0
    schema = "doc_id long, item_id long, start_byte long, end_byte long, item_start int, n_words int, n_equal int"

    def searched():
        sent = spark.sparkContext.broadcast(Index(ids, texts, least, share, identity))
        return rows.mapInArrow(returning(_search(sent, least, share, identity)), schema)

    for row in items.orderBy("item_id").toLocalIterator():  # one block of the query set at a time
        ids.append(row[0])
        texts.append(bytes(row[1]))
        words += len(row[1].split())
        size += len(row[1])
        if words >= block_words or size >= BLOCK_BYTES:
            out = searched() if out is None else out.unionByName(searched())
            ids, texts, words, size = [], [], 0, 0
    if ids or out is None:
        out = searched() if out is None else out.unionByName(searched())
    return out
