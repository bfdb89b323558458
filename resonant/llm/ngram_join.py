"""Operator 6: exact Jaccard self-join of word shingle sets, with set-relation skipping.

A document's set is its distinct shingles of ``k`` lower-cased words, as 64-bit
hashes. Documents link when 100 * |A & B| >= ``percent`` * |A | B|.

1. ``shingle_sets``: one scan gives the size, a 128-bit digest and a few min-hashes
   of each set. Equal sets have equal answers, so from here on one set, under a
   number of its own, stands for all its copies.
2. Index entries: a further scan emits each set's prefix under one global order
   (frequent shingles last), which any two linked sets must share, with the
   position of each shingle. A counting pass before it finds the shingles of more
   than ``short`` sets; they are kept as a bitmap of fixed size, and ``short`` doubles
   until the bitmap is sparse, whatever the input. Its false positives only change
   the order, never the result. A set is emitted once by each task that meets it.
3. Index-level skipping: an inverted list is in order of set size and position, and
   its entries of equal size and position are a block. A block is skipped whole
   where its size, or what can follow its position, cannot reach the overlap with
   another block's. A list of more than ``short`` sets gives no pairs yet.
4. Candidates from lists and from equal min-hashes are verified on whole sets, which
   gives their exact overlaps. Linked sets share one component.
5. Answer-level skipping: in each long list that holds sets of several components, one
   set (the hub) is compared with all others that could link with it. The overlaps
   o(x), o(y) of two sets with the hub bound theirs:

       o(x) + o(y) - |hub| <= |x & y| <= min(o(x), o(y)) + min(|x| - o(x), |y| - o(y))

   so the answers of a set near the hub follow from the hub's, up to the elements in
   which they differ. Only pairs of different components that the bounds leave open
   are verified. Long lists are dealt in cells of bounded size, by size class and part.

Nothing of the size of the input is broadcast: the frequent shingles are a bitmap
of 2**27 bits (16 MB), as is the filter of needed documents (32 MB at most).

Defined cases: null, empty or blank text has an empty set, which links with
nothing; a text of fewer than k words has one shingle, the whole sequence; rows
of equal text (or equal doc_id) are rows of their own; a null doc_id has a null
component and links with nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .components import components
from .ids import maybe_needed
from .scratch import materialise, memory_returned
from .skew import HEAVY, join_per_key
from .workers import returning

#: Lists of more sets than this (or twice, four times, ... as many: see above) give pairs only across components.
SHORT = 24
#: Bits of the map of frequent shingles, and how many of them may be set at most.
MAP_BITS, MAP_SET = 27, 1 << 24
#: Candidates verified against one set at a time.
BLOCK = 32
#: Sets of one size class and part of a long list.
PART = 256
#: Sets that a task remembers having emitted.
_SEEN = 100_000
_MINHASHES = 4
_MULTIPLIERS = [(0x9E3779B97F4A7C15 * (2 * j + 3)) & 0xFFFFFFFFFFFFFFFF | 1 for j in range(_MINHASHES)]


def sets_of(column: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text, in order."""
    data, offsets = bytescan.text_buffer(column)
    for i, j in bytescan.pieces(offsets):
        low = bytescan.lower_ascii(data[offsets[i] : offsets[j]])
        starts, ends, bounds = bytescan.word_spans(low, offsets[i : j + 1] - offsets[i])
        runs, cuts = bytescan.sequence_hashes(bytescan.span_hashes(low, starts, ends), bounds, k)
        for t in range(j - i):
            yield np.unique(runs[cuts[t] : cuts[t + 1]])


def needed_overlap(total, percent: int):
    """The least |A & B| for |A| + |B| = total: 100 o >= percent (total - o)."""
    return -(-percent * total // (100 + percent))


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """Probing and indexing prefix of a set of n: partners of any size, and of at least its own size."""
    return n - -(-percent * n // 100) + 1, n - needed_overlap(2 * n, percent) + 1


# -- 1: one scan for sizes, digests and min-hashes


_SETS = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("k0", pa.int64()), ("k1", pa.int64()), ("mins", pa.list_(pa.int64()))])


def digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(np.bitwise_xor.reduce(bytescan.mix(own))), int(own.sum(dtype=np.uint64))


def _scan(k: int):
    def run(batches):
        for batch in batches:
            rows, mins = [], []
            for own in sets_of(batch.column("text"), k):
                rows.append((len(own), *(digest(own) if len(own) else (0, 0))))
                mins.append([int((own * np.uint64(m)).min().view(np.int64)) for m in _MULTIPLIERS] if len(own) else [])
            n, k0, k1 = (np.array([r[c] for r in rows], np.uint64).view(np.int64) for c in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(n), pa.array(k0), pa.array(k1), pa.array(mins, pa.list_(pa.int64()))], schema=_SETS)

    return run


def _new_sets(batches, k: int):
    """The sets of all texts, each once as far as the task remembers."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for own in sets_of(batch.column("text"), k):
            if len(own):
                key = digest(own)
                if key not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(key)
                    yield own, key


# -- frequent shingles

_SALT = np.uint64(0xD1B54A32D192ED03)
_BLOB = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
_BLOB_SQL = "bucket int, blob binary"


def _cut(rows: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The rows of each bucket as bytes."""
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    starts = np.flatnonzero(np.diff(to, prepend=-1))
    ends = np.append(starts[1:], len(to))
    return to[starts].astype(np.int32), [rows[a:b].tobytes() for a, b in zip(starts, ends)]


def _gathered(batches):
    """(bucket, all its bytes), one bucket at a time; rows come in order of buckets."""
    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != now:
                if held:
                    yield now, b"".join(held)
                now, held = bucket, []
            held.append(blob)
    if held:
        yield now, b"".join(held)


def _dealt(blobs: DataFrame, n: int) -> DataFrame:
    return blobs.repartition(n, "bucket").sortWithinPartitions("bucket")


def _one(bucket: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], schema=_BLOB)


def _tell(k: int, bits: int, flush_at: int = 500_000):
    """Each set as 32-bit values by bucket, the leading ``bits`` of another hash."""

    def run(batches):
        held, count = [], 0

        def blobs():
            m = bytescan.mix(np.concatenate(held) ^ _SALT)
            buckets, parts = _cut(((m >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32), (m >> np.uint64(64 - bits)).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(parts, pa.binary())], schema=_BLOB)

        for own, _ in _new_sets(batches, k):
            held.append(own)
            count += len(own)
            if count >= flush_at:
                yield blobs()
                held, count = [], 0
        if count:
            yield blobs()

    return run


_OFTEN = np.dtype([("value", "<u4"), ("n", "<u4")])


def _often(short: int):
    """The values of more than ``short`` sets of each bucket, and of how many."""

    def run(batches):
        for bucket, blob in _gathered(batches):
            values, n = np.unique(np.frombuffer(blob, np.uint32), return_counts=True)
            many = n > short
            if many.any():
                found = np.empty(int(many.sum()), _OFTEN)
                found["value"], found["n"] = values[many], n[many]
                yield _one(bucket, found.tobytes())

    return run


def _grades(short: int):
    """How many values have more than short * 2**g sets, for each g."""

    def run(batches):
        total = np.zeros(27, np.int64)
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                n = np.frombuffer(blob, _OFTEN)["n"].astype(np.int64)
                total += [(n > short << g).sum() for g in range(len(total))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["g", "n"])

    return run


def _bits(bits: int, short: int):
    """Each bucket's part of the map: a bit for every value of more than ``short`` sets."""

    def run(batches):
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.frombuffer(blob, _OFTEN)
                part = np.zeros(1 << (MAP_BITS - bits), bool)
                part[found["value"][found["n"] > short] >> np.uint32(32 - MAP_BITS + bits)] = True
                yield _one(bucket, np.packbits(part, bitorder="little").tobytes())

    return run


def is_frequent(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = bytescan.mix(h ^ _SALT) >> np.uint64(64 - MAP_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def frequent_map(texts: DataFrame, k: int, short: int) -> tuple[np.ndarray, int]:
    """The packed map, whose parts reach the driver (16 MB together whatever the input), and the sets above which a shingle is in it."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(20, max(8, int(n - 1).bit_length() + 1))
    often = materialise(_dealt(texts.mapInArrow(returning(_tell(k, bits)), _BLOB_SQL), n).mapInArrow(returning(_often(short)), _BLOB_SQL), "frequent")
    grades = often.mapInArrow(_grades(short), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(f"n <= {MAP_SET}").agg(F.min("g")).first()[0]
    short <<= grades or 0
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    size = 1 << (MAP_BITS - bits - 3)
    for bucket, part in often.mapInArrow(_bits(bits, short), _BLOB_SQL).collect():
        out[bucket * size : (bucket + 1) * size] = np.frombuffer(bytes(part), np.uint8)
    return out, short


# -- 2: prefix entries in binary blocks by range of hashes

_ENTRY = np.dtype([("h", "<u8"), ("k0", "<u8"), ("k1", "<u8"), ("n", "<u4"), ("rare", "<u4"), ("pos", "<u4")])


def _emit(k: int, percent: int, buckets: int, last, flush_at: int = 300_000):
    def run(batches):
        frequent = last.value
        held, count = [], 0

        def blobs():
            entries = np.concatenate(held)
            to, parts = _cut(entries, ((entries["h"] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(to), pa.array(parts, pa.binary())], schema=_BLOB)

        for own, key in _new_sets(batches, k):
            n = len(own)
            probe, _ = prefix_lengths(n, percent)
            hot = is_frequent(frequent, own)
            if hot.any():
                own = np.concatenate([own[~hot], own[hot]])
            e = np.empty(probe, _ENTRY)
            e["h"] = own[:probe]
            e["k0"], e["k1"] = key
            e["n"] = n
            e["rare"] = n - int(hot.sum())
            e["pos"] = np.arange(probe)
            held.append(e)
            count += probe
            if count >= flush_at:
                yield blobs()
                held, count = [], 0
        if held:
            yield blobs()

    return run


# -- 3: inverted lists

_LIST = pa.schema([("kind", pa.int8()), ("h", pa.int64()), ("a0", pa.int64()), ("a1", pa.int64()), ("b0", pa.int64()), ("b1", pa.int64()), ("n", pa.int64()), ("rare", pa.int64()), ("pos", pa.int64())])
_LIST_SQL = "kind byte, h long, a0 long, a1 long, b0 long, b1 long, n long, rare long, pos long"


def _lists(percent: int, short: int):
    def run(batches):
        for _, blob in _gathered(batches):
            yield from _walk(np.frombuffer(blob, _ENTRY), percent, short)

    return run


def block_pairs(lists: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int, most: int = 1 << 20):
    """Places of pairs of entries that may link, about ``most`` at a time; entries are in order of list, size and position.

    Entries of equal list, size and position are one block. The smaller set's block
    lies in its indexing prefix; of two blocks, the sizes and what follows the two
    positions bound the overlap of all of their sets at once.
    """
    start = np.flatnonzero(np.concatenate([[True], (lists[1:] != lists[:-1]) | (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])]))
    count = np.diff(np.append(start, len(lists)))
    of, size, at = lists[start], n[start], pos[start]
    live, d, left, right, held = np.flatnonzero(at < size - needed_overlap(2 * size, percent) + 1), 0, [], [], 0
    while len(live):
        live = live[live + d < len(start)]
        # beyond the list's end or the size bound there is nothing for this block: it is skipped from here on
        live = live[(of[live + d] == of[live]) & (size[live] * 100 >= percent * size[live + d])]
        a, b = live, live + d
        near = np.minimum(size[a] - at[a], size[b] - at[b]) >= needed_overlap(size[a] + size[b], percent)
        a, b = a[near], b[near]
        m = count[a] * count[b]
        for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(m) // most)) + 1):
            before = np.concatenate([[0], np.cumsum(m[part])])
            which = np.repeat(part, m[part])
            inner = np.arange(before[-1]) - np.repeat(before[:-1], m[part])
            x, y = start[a[which]] + inner // count[b[which]], start[b[which]] + inner % count[b[which]]
            if d == 0:
                x, y = x[x < y], y[x < y]
            left.append(x)
            right.append(y)
            held += len(x)
            if held >= most:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
        d += 1
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _walk(entries: np.ndarray, percent: int, short: int):
    """Pairs of short lists, and the entries of long ones."""
    e = entries[np.lexsort((entries["k1"], entries["k0"], entries["pos"], entries["n"], entries["h"]))]
    same = np.zeros(len(e), bool)
    same[1:] = (e["h"][1:] == e["h"][:-1]) & (e["k0"][1:] == e["k0"][:-1]) & (e["k1"][1:] == e["k1"][:-1])
    e = e[~same]
    starts = np.flatnonzero(np.concatenate([[True], e["h"][1:] != e["h"][:-1]]))
    length = np.diff(np.append(starts, len(e)))
    own = np.repeat(length, length)
    long_ = e[own > short]
    if len(long_):
        i = lambda name: pa.array(long_[name].astype(np.uint64).view(np.int64))
        z = pa.nulls(len(long_), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(long_), np.int8)), i("h"), i("k0"), i("k1"), z, z, i("n"), i("rare"), i("pos")], schema=_LIST)
    keep = (own > 1) & (own <= short)
    s = e[keep]
    list_id = np.repeat(np.arange(len(starts)), length)[keep]
    if not len(s):
        return
    for left, right in block_pairs(list_id, s["n"].astype(np.int64), s["pos"].astype(np.int64), percent):
        a, b = s[left], s[right]
        pairs = np.unique(np.stack([a["k0"], a["k1"], b["k0"], b["k1"]], axis=1), axis=0).view(np.int64)
        z = pa.nulls(len(pairs), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(pairs), np.int8)), z, *[pa.array(pairs[:, c]) for c in range(4)], z, z, z], schema=_LIST)


# -- 4: verification on whole sets

_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64()), ("linked", pa.bool_())])


def _verify(k: int, percent: int):
    def run(batches):
        hub, name, block, last = None, None, None, None
        for batch in batches:
            rows = []
            sets = sets_of(batch.column("text"), k)
            for key, cid, first, own in zip(batch.column("block").to_pylist(), batch.column("cid").to_pylist(), batch.column("hub").to_pylist(), sets):
                if first:
                    hub, name, block, last = own, cid, key, None
                elif key == block and cid != last:  # repeated rows bring a set's text more than once
                    last = cid
                    both = len(np.intersect1d(hub, own, assume_unique=True))
                    rows.append((name, cid, both, 100 * both >= percent * (len(hub) + len(own) - both)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _PAIR)], schema=_PAIR)

    return run


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int, salt_rows: int = BLOCK) -> DataFrame:
    """(a, b, overlap, linked) of the pairs of sets (a, b). A set with many partners meets them in blocks of about ``salt_rows``."""
    many = materialise(pairs.groupBy("a").agg(F.count("*").alias("size")), "partners").withColumn("m", F.col("size"))
    dealt = join_per_key(pairs, many, ["a"], pairs.count()).select(
        "a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / salt_rows))).alias("block"))
    rows = materialise(dealt.select("block", F.col("a").alias("cid"), F.lit(True).alias("hub")).distinct()
                       .unionByName(dealt.select("block", F.col("b").alias("cid"), F.lit(False).alias("hub"))), "verify")
    total = rows.count()
    uses = rows.groupBy("cid").agg(F.count("*").alias("size")).join(classes.select("cid", F.col("rep").alias("doc_id"), "t"), "cid")
    uses = materialise(uses.withColumn("heavy", F.col("size") * HEAVY > total).withColumn("salts", F.ceil(F.col("size") * HEAVY / F.lit(max(1, total)))), "uses")
    rows = join_per_key(rows, uses, ["cid"], total)
    texts = maybe_needed(docs, uses.select("doc_id"))
    light = rows.where("not heavy").join(texts, ["doc_id", "t"]).select("block", "cid", "hub", "text")
    # the few sets of very many uses are dealt under as many salts as keep each below one in HEAVY of all rows
    few = uses.where("heavy").select("doc_id", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    few = maybe_needed(docs, uses.where("heavy").select("doc_id")).join(few, ["doc_id", "t"])
    salted = rows.where("heavy").withColumn("salt", F.pmod(F.xxhash64("block"), "salts"))
    placed = light.unionByName(salted.join(few, ["doc_id", "t", "salt"]).select("block", "cid", "hub", "text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartition(n, "block").sortWithinPartitions("block", F.desc("hub"), "cid")
    return ordered.mapInArrow(returning(_verify(k, percent)), "a long, b long, overlap long, linked boolean")


# -- the operator


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _cells(waiting: DataFrame, percent: int, total: int) -> DataFrame:
    """Pairs x, y of the entries of one list in cells (list, size classes, parts) of about PART by PART sets.

    Sizes that link lie in one size class or in neighbouring ones, so other classes never meet.
    """
    step = math.log(100 / percent) if percent < 100 else None
    cls = F.floor(F.log(F.col("n").cast("double")) / step) if step else F.col("n")
    rows = waiting.withColumn("s", cls.cast("long"))
    parts = materialise(rows.groupBy("h", "s").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / PART)), "parts")
    above = parts.select("h", (F.col("s") - 1).alias("s"), F.col("parts").alias("above"))
    below = parts.select("h", (F.col("s") + 1).alias("s"), F.col("parts").alias("below"))
    parts = parts.join(above, ["h", "s"], "left").join(below, ["h", "s"], "left")
    own = join_per_key(rows, parts, ["h", "s"], total).withColumn("p", F.pmod(F.xxhash64("cid"), "parts"))
    cell = lambda lo, hi, i, j: F.struct(lo.alias("lo"), hi.alias("hi"), i.alias("i"), j.alias("j"))
    s, p, zero = F.col("s"), F.col("p"), F.lit(0).cast("long")
    upto = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    left = F.concat(F.transform(upto(p, F.col("parts") - 1), lambda q: cell(s, s, p, q)), F.transform(upto(zero, F.coalesce("above", zero) - 1), lambda q: cell(s, s + 1, p, q)))
    right = F.concat(F.transform(upto(zero, p), lambda q: cell(s, s, q, p)), F.transform(upto(zero, F.coalesce("below", zero) - 1), lambda q: cell(s - 1, s, q, p)))
    entry = F.struct("cid", "c", "n", "rare", "pos", "o", "hub_n")
    x = own.select("h", F.explode(left).alias("cell"), entry.alias("x"))
    y = own.select("h", F.explode(right).alias("cell"), entry.alias("y"))
    return x.join(y, ["h", "cell"])


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, short: int = SHORT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of ``docs``."""
    spark = docs.sparkSession
    memory_returned(spark)
    text = F.col("text").cast("binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    sets = materialise(texts.mapInArrow(returning(_scan(k)), "doc_id long, t long, n long, k0 long, k1 long, mins array<long>"), "sets")
    frequent, short = frequent_map(texts, k, short)
    last = spark.sparkContext.broadcast(frequent)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = materialise(_dealt(texts.mapInArrow(returning(_emit(k, percent, 4 * n, last)), _BLOB_SQL), n).mapInArrow(returning(_lists(percent, short)), _LIST_SQL), "lists")
    last.destroy()
    memory_returned(spark)

    classes = sets.where("n > 0 and doc_id is not null").groupBy("k0", "k1").agg(F.min(F.struct("doc_id", "t")).alias("r"), F.first("n").alias("n"), F.first("mins").alias("mins"))
    classes = materialise(classes.select("k0", "k1", F.col("r.doc_id").alias("rep"), "r.t", "n", "mins", F.monotonically_increasing_id().alias("cid")), "classes")
    name = lambda side: classes.select(F.col("k0").alias(f"{side}0"), F.col("k1").alias(f"{side}1"), F.col("cid").alias(side))
    paired = lists.where("kind = 0").select("a0", "a1", "b0", "b1").distinct().join(name("a"), ["a0", "a1"]).join(name("b"), ["b0", "b1"]).select("a", "b")
    mins = classes.select("cid", "n", F.posexplode("mins").alias("j", "v"))
    hubs = mins.groupBy("j", "v").agg(F.min(F.struct("cid", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    n_mins = _MINHASHES * classes.count()
    stars = (join_per_key(mins, materialise(hubs, "hubs"), ["j", "v"], n_mins).where(f"cid <> hub.cid and 100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")
             .select(F.col("hub.cid").alias("a"), F.col("cid").alias("b")))
    candidates = materialise(_ordered(paired.union(stars)), "candidates")
    known = materialise(verified(texts, classes, candidates, k, percent), "overlaps")
    edges = known.where("linked").select("a", "b")
    memory_returned(spark)

    label = lambda e: materialise(components(e).select(F.col("node").alias("cid"), F.col("component").alias("c")), "components")
    part = label(edges)
    entries = lists.where("kind = 1").select("h", "a0", "a1", "n", "rare", "pos").join(name("a"), ["a0", "a1"]).select("h", "n", "rare", "pos", F.col("a").alias("cid"))

    def open_lists(rows: DataFrame, part: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """The entries of the lists that hold sets of more than one component, these lists' sizes, and the entries' number."""
        rows = materialise(rows.join(part, "cid", "left").select("h", "n", "rare", "pos", "cid", F.coalesce("c", "cid").alias("c")), "entries")
        mixed = rows.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("h", "size")
        mixed = materialise(mixed, "mixed-lists")
        kept = materialise(join_per_key(rows, mixed, ["h"], rows.count()), "long-lists")
        return kept, mixed, kept.count()

    # Sets of a long list hold all of their rare shingles in their prefixes, so two that share one have met in a
    # short list. Any others share frequent shingles alone, which bounds their overlap, as do sizes and positions.
    needed = f"ceil({percent} * ({{x}}.n + {{y}}.n) / {100 + percent})"
    fits = (f"100 * least({{x}}.n, {{y}}.n) >= {percent} * greatest({{x}}.n, {{y}}.n) and "
            f"least({{x}}.n - {{x}}.rare, {{y}}.n - {{y}}.rare) >= {needed}")
    waiting, sizes, total = open_lists(entries, part)
    if total:
        # the hub: of each list's largest component the set of fewest rare shingles, of which others may be edits
        best = waiting.groupBy("h", "c").agg(F.count("*").alias("m"), F.min(F.struct("rare", "cid", "n")).alias("best"))
        hub = best.groupBy("h").agg(F.max_by("best", F.struct("m", "best")).alias("hub")).join(sizes, "h")
        met = materialise(join_per_key(waiting.select("h", F.struct("cid", "n", "rare").alias("x")), materialise(hub, "list-hubs"), ["h"], total), "hub-pairs")
        new = _ordered(met.where(fits.format(x="x", y="hub")).select(F.col("hub.cid").alias("a"), F.col("x.cid").alias("b")))
        new = materialise(new.join(known, ["a", "b"], "left_anti"), "to-hubs")
        known = known.unionByName(materialise(verified(texts, classes, new, k, percent), "overlaps"))
        memory_returned(spark)
        edges = known.where("linked").select("a", "b")
        part = label(edges)
        waiting, _, total = open_lists(waiting.drop("c"), part)
    if total:
        # each set's overlap with its list's hub, where it is known; the hub's own is its size
        pair = met.select("h", F.col("x.cid").alias("cid"), F.col("hub.cid").alias("hub"), F.col("hub.n").alias("hub_n"),
                          F.least("x.cid", "hub.cid").alias("a"), F.greatest("x.cid", "hub.cid").alias("b"))
        told = pair.join(known, ["a", "b"], "left").select("h", "cid", "hub_n", F.when(F.col("cid") == F.col("hub"), F.col("hub_n")).otherwise(F.col("overlap")).alias("o"))
        waiting = materialise(waiting.join(told, ["h", "cid"]), "long-lists")
        pairs = _cells(waiting, percent, total).where(
            "x.c <> y.c and x.cid <> y.cid and " + fits.format(x="x", y="y") + f" and least(x.n - x.pos, y.n - y.pos) >= {needed.format(x='x', y='y')}")
        need = F.expr(needed.format(x="x", y="y"))
        most = F.least("x.o", "y.o") + F.least(F.col("x.n") - F.col("x.o"), F.col("y.n") - F.col("y.o"))
        pairs = pairs.where(F.coalesce(most >= need, F.lit(True)))
        sure = F.coalesce(F.col("x.o") + F.col("y.o") - F.col("x.hub_n") >= need, F.lit(False))
        pairs = pairs.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"), sure.alias("sure"))
        pairs = pairs.groupBy("a", "b").agg(F.max("sure").alias("sure"))
        pairs = materialise(pairs.join(known, ["a", "b"], "left_anti"), "across")
        found = materialise(verified(texts, classes, pairs.where("not sure").select("a", "b"), k, percent), "overlaps")
        edges = edges.union(found.where("linked").select("a", "b")).union(pairs.where("sure").select("a", "b"))
        part = label(edges)

    lowest = part.join(classes.select("cid", "rep"), "cid")
    lowest = lowest.groupBy("c").agg(F.min("rep").alias("low"))
    labels = classes.select("k0", "k1", "cid", "rep").join(part.join(lowest, "c").select("cid", "low"), "cid", "left").select("k0", "k1", F.coalesce("low", "rep").alias("component"))
    out = sets.join(labels, ["k0", "k1"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
