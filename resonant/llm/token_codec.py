"""Operator 1: token ids in word-aligned Simple-8b files.

``write_shards`` encodes whole texts and writes them in ascending document
order; ``read_shards`` gives the documents back. A shard is one range of
document ids, held as rows of one segment each, in Parquet so that Spark's
commit protocol covers lost executors and any Hadoop file system works. A
segment is a self-contained little-endian binary:

    magic "RS8B0001", u32 documents, u32 blocks, u64 ids, u64 words
    i64 document id [documents], u8 null flag [documents], u64 ids [documents]
    u32 first word of each block [blocks + 1], u64 word [words]

Every block has 256 ids (the last one fewer). The low four bits of a word are
its selector, the other 60 hold ids of one width: see ``SELECTORS``. Selector 0
is the escape: one value that no packed width holds. Block offsets allow all
words of a segment, or any block, to be decoded at once.

Defined cases: a null text is an empty one (its ids: the end id alone); a null
doc_id sorts first; repeated rows are encoded each; rows of equal doc_id keep
text order; an empty table gives no segment; extra columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytescan, tokens
from .scratch import new_path

MAGIC = b"RS8B0001"
BLOCK = 256
#: (ids in a word, bits of each) by selector; fixed values of this format.
SELECTORS = [(1, 60), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30)]
_COUNT = np.array([c for c, _ in SELECTORS] + [0, 0], np.int64)
#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 18

_SEGMENT = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int32()), ("payload", pa.binary())])
SEGMENT_SCHEMA = "shard int, segment int, first_id long, n_ids long, n_docs int, payload binary"


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed words of the ids, and each block's first word (with the end after the last)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.zeros(1, np.uint32)
    grid = np.zeros((blocks, BLOCK + 60), np.uint64)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = ids
    grid[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    choice = np.zeros((blocks, BLOCK), np.uint8)
    open_ = np.ones((blocks, BLOCK), bool)
    for s, (count, bits) in enumerate(SELECTORS):
        if s == 0:
            continue
        wide = (grid >> np.uint64(bits)) != 0
        total = np.zeros((blocks, BLOCK + 61), np.int32)
        np.cumsum(wide, axis=1, out=total[:, 1:])
        fits = open_ & (total[:, count : count + BLOCK] == total[:, :BLOCK])
        choice[fits] = s
        open_ &= ~fits
        if not open_.any():
            break
    step = _COUNT[choice].ravel()
    end = np.full(blocks, BLOCK)
    end[-1] = n - (blocks - 1) * BLOCK
    base = np.arange(blocks) * BLOCK
    pos, rows, cols = np.zeros(blocks, np.int64), [], []
    live = np.arange(blocks)
    while len(live):
        at = base[live] + pos[live]
        rows.append(live)
        cols.append(pos[live])
        pos[live] += step[at]
        live = live[pos[live] < end[live]]
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    order = np.lexsort((cols, rows))
    rows, cols = rows[order], cols[order]
    sel = choice[rows, cols]
    words = sel.astype(np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        at = np.flatnonzero(sel == s)
        for j in range(count if len(at) else 0):
            words[at] |= grid[rows[at], cols[at] + j] << np.uint64(4 + j * bits)
    return words, np.searchsorted(rows, np.arange(blocks + 1)).astype(np.uint32)


def decode_words(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The ids that ``encode_words`` packed."""
    out = np.zeros(n, np.uint32)
    if not n:
        return out
    sel = (words & np.uint64(15)).astype(np.int64)
    block = np.repeat(np.arange(len(first) - 1), np.diff(first.astype(np.int64)))
    before = np.concatenate([[0], np.cumsum(_COUNT[sel])])
    at = before[:-1] - before[first[:-1].astype(np.int64)][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for s, (count, bits) in enumerate(SELECTORS):
        rows = np.flatnonzero(sel == s)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count if len(rows) else 0):
            to = at[rows] + j
            ok = to < end[rows]
            out[to[ok]] = (words[rows[ok]] >> np.uint64(4 + j * bits)) & mask
    return out


def pack_segment(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, first = encode_words(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    own = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = MAGIC + struct.pack("<IIQQ", len(doc_ids), len(first) - 1, len(ids), len(words))
    return b"".join([head, own.tobytes(), null.tobytes(), lengths.astype("<u8").tobytes(), first.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def unpack_segment(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, the number of ids of each, and all ids."""
    if payload[:8] != MAGIC:
        raise ValueError("not a segment of packed token ids")
    docs, blocks, n, words = struct.unpack_from("<IIQQ", payload, 8)
    at = 32

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(payload, kind, count, at)
        at += got.nbytes
        return got

    own, null, lengths, first = take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u4", blocks + 1)
    ids = decode_words(take("<u8", words).astype(np.uint64), first, n)
    return [None if z else d for d, z in zip(own.tolist(), null.tolist())], lengths.astype(np.int64), ids


def _writer(tokenizer: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        shard, segment, first_id = TaskContext.get().partitionId(), 0, 0
        held, sizes, parts, n = [], [], [], 0

        def close():
            nonlocal segment, first_id, held, sizes, parts, n
            payload = pack_segment(held, np.array(sizes, np.int64), np.concatenate(parts))
            row = pa.RecordBatch.from_pylist([{"shard": shard, "segment": segment, "first_id": first_id, "n_ids": n, "n_docs": len(held), "payload": payload}], _SEGMENT)
            segment, first_id = segment + 1, first_id + n
            held, sizes, parts, n = [], [], [], 0
            return row

        encoder = tokens.encoder(tokenizer)
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            data, offsets = bytescan.text_buffer(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for i, j in bytescan.pieces(offsets):
                ids, bounds = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k in range(j - i):
                    own = ids[bounds[k] : bounds[k + 1]]
                    held.append(names[i + k])
                    sizes.append(len(own) + 1)
                    parts += [own, tail]
                    n += len(own) + 1
                    if n >= SEGMENT_IDS:
                        yield close()
        if held:
            yield close()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shards: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``path`` in ascending doc_id order.

    One range exchange of the texts by doc_id; each task then holds one batch
    and one segment. ``shards`` defaults to the session's shuffle partitions.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    (ordered.mapInArrow(_writer(tokenizer, end_id), SEGMENT_SCHEMA)
        .write.mode("overwrite").option("compression", "uncompressed").parquet(path))


def _reader(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for base, payload in zip(batch.column("base").to_pylist(), batch.column("payload").to_pylist()):
            names, lengths, ids = unpack_segment(payload)
            before = np.concatenate([[0], np.cumsum(lengths)])
            raw = ids.astype("<u4").tobytes()
            cut = (before * 4).tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array(names, pa.int64()), pa.array(base + before[:-1], pa.int64()), pa.array(lengths, pa.int64()),
                pa.array([raw[a:b] for a, b in zip(cut, cut[1:])], pa.binary())], schema=schema)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian u32) from the files.

    Shards follow one another in document order, so a shard's first position is
    the sum of the sizes before it: one row per shard (a number that
    ``write_shards`` fixes, not one that grows with the rows) is summed and
    broadcast.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    sizes = segments.groupBy("shard").agg(F.sum("n_ids").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shard_start"))
    placed = segments.join(F.broadcast(starts), "shard").select((F.col("shard_start") + F.col("first_id")).alias("base"), "payload")
    return placed.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the shards to the shared folder, and read them back."""
    spark = docs.sparkSession
    path = new_path(spark, "token-shards")
    write_shards(docs, path, tokenizer, end_id)
    return read_shards(spark, path)
