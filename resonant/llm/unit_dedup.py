"""Operator 7: substring deduplication by hashing units of lines or paragraphs.

A text is cut into units: its lines, cut again after a sentence end, so that a
passage inside a line is seen; or its paragraphs, between blank lines. A unit is
normalised (lower case, runs of anything but letters and digits as one space) and
weighs its words, or an eighth of its characters where that is more (scripts
without spaces). A passage is what begins at a unit and goes on for as few units
as weigh ``min_words`` together, across lines if need be; its digest is made of
its units' 128-bit digests. Where it ends follows from its content alone, so a
passage has one digest wherever it stands.

Digests are grouped over all documents. Of each the occurrence of least rank
(doc_id, then place in the text) stays, and every other one goes. A lone short
repeat never makes a passage and stays. What goes is listed with its offsets in
the original text, so the original can be rebuilt. Where occurrences overlap in
one text, its first period stays.

Digests are pre-aggregated before the shuffle (least and greatest rank, a count).
A digest that holds a large share of all passages is matched by broadcast (few
of them can exist, whatever the input); the others meet their first occurrence in
an equality join, where none can fill a task (see ``skew``).
Texts are moved once, to be joined to their spans.

All scans of a text are linear in its length.

Defined cases: a null text stays null, with no spans; a row of null doc_id is
neither counted nor changed; repeated rows (equal doc_id and text) have equal
ranks, so all of them keep what one keeps and are no repeats of each other; an
empty table gives no rows; columns other than doc_id and text are ignored. Spans
are in characters, end exclusive, and hold the units' line feeds, so the kept
pieces in a row are the new text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise
from .skew import join_per_key

_END = {
    "line": re.compile(r"\n|(?<=[.!?])[ \t\r]+\n?|(?<=[\u3002\uff01\uff1f])"),
    "paragraph": re.compile(r"\n(?:[ \t\r]*\n)+"),
}
_WORD = re.compile(r"[^\W_]+")


def units_of(text: str, unit: str):
    """(start, end) of each unit; a unit holds what ends it, and all of them make up the text."""
    at = 0
    for m in _END[unit].finditer(text):
        if m.end() > at:
            yield at, m.end()
            at = m.end()
    if at < len(text):
        yield at, len(text)


def normalised(unit: str) -> str:
    return " ".join(_WORD.findall(unit.lower()))


def passages_of(text: str, unit: str, min_words: int):
    """(first unit, last unit, start, end, digest) of each passage; units without words are not numbered."""
    starts, ends, weights, digests = [], [], [], []
    for a, b in units_of(text, unit):
        words = _WORD.findall(text[a:b].lower())
        if words:
            plain = " ".join(words)
            starts.append(a)
            ends.append(b)
            weights.append(max(len(words), len(plain) // 8))
            digests.append(hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).digest())
    upto, held = 0, 0
    for i in range(len(starts)):
        while upto < len(starts) and held < min_words:
            held += weights[upto]
            upto += 1
        if held < min_words:
            return
        digest = digests[i] if upto == i + 1 else hashlib.blake2b(b"".join(digests[i:upto]), digest_size=16).digest()
        yield i, upto - 1, starts[i], ends[upto - 1], digest
        held -= weights[i]


_ROWS = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("digest", pa.binary())])
_ROWS_SQL = "doc_id long, t long, i int, j int, start long, end long, digest binary"
#: Rows of passages in a batch.
_MANY = 20_000


def _scan(unit: str, min_words: int):
    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_ROWS), _ROWS)], schema=_ROWS)

    def run(batches):
        rows = []
        for batch in batches:
            for doc, t, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "t", "text"))):
                for passage in passages_of(text, unit, min_words):
                    rows.append((doc, t, *passage))
                    if len(rows) >= _MANY:
                        yield batch_of(rows)
                        rows = []
        yield batch_of(rows)

    return run


def merged(passages: list) -> list:
    """Spans (start, end, first_doc) of passages in order of start; those that touch or overlap are one."""
    out = []
    for p in passages:
        if out and p["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], p["end"])
        else:
            out.append({"start": p["start"], "end": p["end"], "first_doc": p["first_doc"]})
    return out


def _covered(passages: list) -> int:
    """The number of units in the passages."""
    n, upto = 0, -1
    for p in passages:
        n += max(0, p["j"] - max(upto, p["i"] - 1))
        upto = max(upto, p["j"])
    return n


_SPANS = "array<struct<start:bigint,end:bigint,first_doc:bigint>>"
_OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_doc", pa.int64())]))),
                  ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_repeated", pa.int64())])


def _rebuild(unit: str):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found"))):
                found = sorted(found or [], key=lambda p: p["i"])
                gone = [p for p in found if not p["stays"]]
                spans = merged(gone)
                n = 0 if text is None else sum(1 for a, b in units_of(text, unit) if _WORD.search(text, a, b))
                if spans:
                    at, kept = 0, []
                    for span in spans:
                        kept.append(text[at : span["start"]])
                        at = span["end"]
                    text = "".join([*kept, text[at:]])
                rows.append((doc, text, spans, n, _covered(gone), _covered(found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_OUT), _OUT)], schema=_OUT)

    return run


def drop_repeated_units(docs: DataFrame, unit: str = "line", min_words: int = 30) -> DataFrame:
    """doc_id, text (what is kept), removed (start, end and the document that keeps the passage, in order) and counts.

    The counts are of units with words: n_units in all, n_removed of them, and
    n_repeated in passages that stand in more than one place, the place that
    keeps them included.
    """
    if unit not in _END:
        raise ValueError("unit is line or paragraph")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("string").alias("text"))
    passages = materialise(rows.where("doc_id is not null and text is not null").mapInArrow(_scan(unit, min_words), _ROWS_SQL), "passages")
    rank = F.struct(F.col("doc_id").alias("d"), F.col("t").alias("t"), F.col("i").alias("i"))
    first = passages.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.count("*").alias("n")).where("first <> last")
    first = materialise(first.select("digest", "first", "n"), "first-places")
    met = join_per_key(passages, first, ["digest"], passages.count(), "n")
    found = met.select("doc_id", "t", F.struct("i", "j", "start", "end", F.col("first.d").alias("first_doc"), (rank == F.col("first")).alias("stays")).alias("p"))
    found = found.groupBy("doc_id", "t").agg(F.collect_set("p").alias("found"))
    joined = rows.join(found, ["doc_id", "t"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_rebuild(unit), f"doc_id long, text string, removed {_SPANS}, n_units long, n_removed long, n_repeated long")


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, [x FOR x IN string_split(regexp_replace(regexp_replace(text, '([.!?][ \t\r]+\n?|\n)', '\1' || chr(1), 'g'), '([\x{3002}\x{FF01}\x{FF1F}])', '\1' || chr(1), 'g'), chr(1)) IF x <> ''] AS p
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
parts AS (SELECT doc_id, unnest(range(len(p))) AS k, unnest(p) AS part FROM cut),
placed AS (
  SELECT doc_id, k, part, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS stop,
    trim(regexp_replace(lower(part), '[^\p{L}\p{N}]+', ' ', 'g')) AS plain FROM parts),
units AS (
  SELECT doc_id, stop - length(part) AS start, stop, plain, greatest(len(string_split(plain, ' ')), length(plain) // 8) AS weight,
    CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS i FROM placed WHERE plain <> ''),
sums AS (SELECT *, CAST(sum(weight) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM units),
lists AS (SELECT doc_id, list(plain ORDER BY i) AS plains, count(*) AS n_units FROM units GROUP BY doc_id),
passages AS (
  SELECT a.doc_id, a.i, z.i AS j, a.start, z.stop, array_to_string(l.plains[a.i:z.i], chr(10)) AS content
  FROM sums a ASOF JOIN sums z ON a.doc_id = z.doc_id AND a.upto - a.weight + 30 <= z.upto JOIN lists l ON l.doc_id = a.doc_id),
firsts AS (SELECT content, min(struct_pack(d := doc_id, i := i)) AS f FROM passages GROUP BY content HAVING count(*) > 1),
met AS (SELECT p.doc_id, p.i, p.j, p.start, p.stop, f.f.d AS first_doc, struct_pack(d := p.doc_id, i := p.i) = f.f AS stays FROM passages p JOIN firsts f ON p.content = f.content),
told AS (SELECT u.doc_id, u.i, bool_or(NOT m.stays) AS gone FROM units u JOIN met m ON u.doc_id = m.doc_id AND u.i BETWEEN m.i AND m.j GROUP BY u.doc_id, u.i),
counts AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) AS n_repeated FROM told GROUP BY doc_id),
edges AS (
  SELECT *, start > coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS opens FROM met WHERE NOT stays),
islands AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM edges),
spans AS (SELECT doc_id, island, min(start) AS start, max(stop) AS stop, arg_min(first_doc, i) AS first_doc FROM islands GROUP BY doc_id, island),
listed AS (
  SELECT doc_id, string_agg(start || '-' || stop || ':' || first_doc, ',' ORDER BY start) AS removed FROM spans GROUP BY doc_id),
kept AS (
  SELECT p.doc_id, string_agg(part, '' ORDER BY k) AS text FROM placed p
  WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = p.doc_id AND s.start <= p.stop - length(p.part) AND p.stop <= s.stop) GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(l.removed, '') AS removed, coalesce(x.n_units, 0) AS n_units,
  coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_repeated, 0) AS n_repeated
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN listed l ON d.doc_id = l.doc_id LEFT JOIN lists x ON d.doc_id = x.doc_id LEFT JOIN counts c ON d.doc_id = c.doc_id
"""
