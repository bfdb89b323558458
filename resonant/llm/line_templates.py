"""Operator 4: removal of lines whose template recurs across documents. DataFrame functions only.

A line is parsed as in a log parser's tree of fixed depth, by its number of tokens
and then by some of its tokens, where one that holds a digit, an ``@`` or ``://``
stands as ``<*>``. There are ``CLASSES`` such trees besides the one of whole lines:
tree c goes by the places c, c + ``CLASSES``, c + 2 * ``CLASSES`` ... from the leading
ones on, or, for a line of fewer than ``SHORT`` tokens, by all other places. So lines
that vary in a field or two, wherever these are, share a leaf of some tree (up to
``CLASSES`` - 1 fields in long lines), the first token being no exception.

A leaf is a group whose template keeps the places in which its lines agree and
generalises the others. What agrees is told from one bit for each of the first
``PLACES`` tokens, by the and and the or of the lines' bits, so no line is compared
with another. A leaf whose template keeps less than ``SIMILAR`` of its places holds
unlike lines. If it has ``min_documents`` documents, it is parted into groups by
similarity: a line joins the group with whose template it shares most tokens,
``SIMILAR`` of all places at least, and the template keeps what they share; else it
begins a group. A token that so many documents do not have in its place is in no
template that recurs, so it is none of a line's tokens here, and a line that has too
few others is in no group. Lines are grouped in cells of about ``CELL``, then the
cells' templates. Leaves of unlike lines alone have their tokens looked at.

A template of at least ``min_documents`` documents recurs. With ``long_words``, that
of a whole line recurs from two documents on if it has so many tokens that are not
generalised: a long line does not recur by chance. A line that fits a
recurring template goes, unless its document is the first (least doc_id) of every
recurring template it fits. Templates are counted per document before they are
shuffled, so a template of very many documents is pre-aggregated; texts are
shuffled once, to be joined to the numbers of their dropped lines, when the
templates' shuffle files are gone.

Defined cases: lines end at line feeds, tokens at single spaces or tabs; blank lines neither count nor go; a null
text stays null; a row of null doc_id is neither counted nor changed; each row is
a document (a repeated row counts again, and keeps what its twin keeps); an empty
table gives no rows; all columns of the input are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ids import maybe_needed
from .scratch import materialise, shuffles_removed

CLASSES, SHORT, PLACES, SIMILAR = 3, 9, 56, 0.5
#: Tokens of a line that may be generalised, at least.
WILD_FROM = 4
#: Different lines of an unlike leaf that one task groups at a time.
CELL = 1000
#: Marks a token that holds a digit, an at sign or a scheme.
FIELD = r"[^ \t]*(?:[0-9@]|://)[^ \t]*"
#: The same in fewer steps, as it is tried where tokens begin alone and never goes back; DuckDB has no such patterns.
FIELD_AT_ONCE = r"(?<![^ \t])[^ \t0-9@:]*+(?::(?!//)[^ \t0-9@:]*+)*+[0-9@:][^ \t]*+"
EDGE = r"^[ \t\r]+|[ \t\r]+$"


def _words(rows: DataFrame) -> DataFrame:
    """``rows`` with the column w, the tokens of each line that is not blank; the fields' pattern runs only on lines that hold one."""
    rows = rows.withColumn("line_text", F.btrim("content", F.lit(" \t\r"))).where("line_text <> ''")
    field = F.regexp_replace("line_text", FIELD_AT_ONCE, "<*>")
    rows = rows.withColumn("line_text", F.when(F.col("line_text").rlike("[0-9@]") | F.contains("line_text", F.lit("://")), field).otherwise(F.col("line_text")))
    return rows.withColumn("w", F.split(F.replace("line_text", F.lit("\t"), F.lit(" ")), " "))


def _parsed(rows: DataFrame) -> DataFrame:
    """``rows`` with the column keys, the hashes of the templates of each line that is not blank.

    Step by step, so that no expression is worked out twice.
    """
    size = F.size("w")
    rows = _words(rows).withColumn("size", size)
    for c in range(CLASSES):
        own = F.transform(F.sequence(F.lit(c), size - 1, F.lit(CLASSES)), lambda i: F.get("w", i))
        rows = rows.withColumn(f"h{c}", F.when(size >= WILD_FROM, F.xxhash64(own)))
    for c in range(CLASSES):
        others = [f"h{o}" for o in range(CLASSES) if o != c]
        rows = rows.withColumn(f"c{c}", F.when(size >= SHORT, F.xxhash64(F.lit(c + 1), size, f"h{c}")).otherwise(F.xxhash64(F.lit(c + 1), size, *others)))
    # the trees' places are all places, so their hashes tell a whole line
    whole = F.xxhash64(F.lit(0), size, *[f"h{c}" for c in range(CLASSES)])
    rows = rows.withColumn("keys", F.when(size >= WILD_FROM, F.array(whole, *[f"c{c}" for c in range(CLASSES)])).otherwise(F.array(F.xxhash64(F.lit(0), size, "w"))))
    # a bit of each token: whether the sum of its length and of the codes of its first and third characters is odd
    bit = lambda x: (F.length(x) + F.ascii(x) + F.ascii(F.substring(x, 3, 1))).cast("long").bitwiseAND(F.lit(1).cast("long"))
    return rows.withColumn("bits", F.aggregate(F.slice("w", 1, PLACES), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(bit(x))))


#: Templates of the groups of ``p``, an array of lines (or templates) whose tokens are null where they do not count.
_GROUPS = f"""
aggregate(p, cast(array() as array<array<string>>), (groups, x) -> element_at(transform(
  array(array_max(transform(groups, (g, i) -> struct(size(filter(zip_with(g, x, (a, b) -> a = b), e -> e)) as shared, -i as i)))),
  best -> if(best.shared >= {SIMILAR} * size(x),
    transform(groups, (g, i) -> if(i = -best.i, zip_with(g, x, (a, b) -> if(a = b, a, null)), g)),
    concat(groups, array(x)))), 1))"""


def _grouped(lines: DataFrame, *by: str) -> DataFrame:
    """(key, p): the templates of the groups of the different ``p`` of each ``by``, those of fewest tokens first."""
    order = F.struct(F.size(F.filter("p", lambda x: x.isNotNull())).alias("kept"), "p")
    held = lines.groupBy(*by).agg(F.sort_array(F.collect_set(order)).alias("p")).withColumn("p", F.col("p.p"))
    return held.select("key", F.explode(F.expr(_GROUPS)).alias("p"))


def _parted_hits(rows: DataFrame, members: DataFrame, min_documents: int) -> DataFrame:
    """(d, t, line) of the lines that go by the templates of groups. ``members``: (key, d, t, line) of all lines of unlike leaves."""
    lines = _words(rows.select("d", "t", F.posexplode("lines").alias("line", "content"))).select("d", "t", "line", "w")
    lines = materialise(lines.join(members.hint("merge"), ["d", "t", "line"]).select("key", "d", "t", "line", "w"), "unlike-lines")
    # tokens of enough documents in a place; one that has a token there in two lines counts twice, which leaves more lines in
    different = lines.groupBy("key", "w").agg(F.count_distinct("d", "t").alias("n"))
    different = materialise(different.withColumn("u", F.monotonically_increasing_id()), "different-lines")
    places = different.select("key", "u", "n", F.posexplode("w").alias("i", "x"))
    often = places.groupBy("key", "i", "x").agg(F.sum("n").alias("n")).where(F.col("n") >= min_documents).drop("n")
    # a file of repeated tokens is small, its tokens in rows are not: by its size it would be broadcast
    found = places.select("key", "u", "i", "x").join(often.hint("merge"), ["key", "i", "x"]).groupBy("u").agg(F.collect_set("i").alias("places"))
    found = different.join(found.hint("merge"), "u").where(F.size("places") >= SIMILAR * F.size("w"))
    kept = F.transform("w", lambda x, i: F.when(F.array_contains("places", i), x))
    patterns = materialise(found.select("key", kept.alias("p")).distinct(), "patterns")
    cells = patterns.groupBy("key").agg(F.ceil(F.count("*") / CELL).alias("cells"))
    patterns = patterns.join(cells, "key").withColumn("cell", F.pmod(F.xxhash64("p"), "cells"))
    templates = materialise(_grouped(_grouped(patterns, "key", "cell"), "key"), "groups")
    fits = F.forall(F.zip_with("p", "w", lambda a, b: F.coalesce(a == b, F.lit(True))), lambda e: e)
    fitting = materialise(lines.join(templates.hint("merge"), "key").where(fits).select("key", "p", "d", "t", "line"), "fitting")
    recurring = fitting.groupBy("key", "p").agg(F.count_distinct("d", "t").alias("n"), F.min("d").alias("first")).where(F.col("n") >= min_documents)
    return fitting.join(recurring.hint("merge"), ["key", "p"]).where(F.col("d") > F.col("first")).select("d", "t", "line")


def drop_recurring_lines(docs: DataFrame, min_documents: int = 5, text: str = "text", doc_id: str = "doc_id", long_words: int | None = None) -> DataFrame:
    """``docs`` with the column ``text`` rewritten, and with n_lines and n_dropped after its own columns.

    A column of the input that is named n_lines or n_dropped is replaced.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lines = F.split(F.col(text), "\n")
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.hash(text).alias("t"), F.posexplode(lines).alias("line", "content"))
    long = F.size(F.array_remove("w", "<*>")) >= long_words if long_words else F.lit(False)
    # one number holds a line's bits, how many there are, and whether it is long; (d, t) tells rows of equal doc_id apart
    packed = F.col("bits").bitwiseOR(F.shiftleft(F.least("size", F.lit(PLACES)).cast("long"), PLACES)).bitwiseOR(F.when(long, F.lit(1 << 62)).otherwise(F.lit(0).cast("long")))
    parsed = materialise(_parsed(rows).select("d", "t", "line", "keys", packed.alias("bits")), "line-templates")
    # lines of one text are together in a task, so its templates are made distinct before the shuffle
    both = [F.bit_and("all").alias("all"), F.bit_or("any").alias("any")]
    flag = F.when(F.col("kind") == 0, F.col("bits")).otherwise(F.col("bits").bitwiseAND(F.lit((1 << 62) - 1)))
    each = parsed.select("d", "t", "bits", F.posexplode("keys").alias("kind", "key")).select("d", "t", "key", flag.alias("all"), flag.alias("any"))
    in_docs = each.groupBy("key", "d", "t").agg(*both)
    recurring = in_docs.groupBy("key").agg(F.count("*").alias("documents"), F.min("d").alias("first"), *both)
    size = F.shiftright("any", PLACES).bitwiseAND(F.lit(63))
    alike = size - F.bit_count(F.expr(f"(`all` ^ `any`) & {(1 << PLACES) - 1}L")) >= SIMILAR * size
    needed = F.when(F.col("any") >= 1 << 62, min(2, min_documents)).otherwise(min_documents)
    recurring = recurring.where(F.col("documents") >= needed).select("key", "first", alike.alias("alike"))
    placed = parsed.select("d", "t", "line", F.explode("keys").alias("key"))
    with shuffles_removed(docs.sparkSession):  # those of the templates go before the texts are shuffled
        recurring = materialise(recurring, "recurring")
        hits = placed.join(recurring.where("alike").hint("merge"), "key").where(F.col("d") > F.col("first")).select("d", "t", "line")
        unlike = recurring.where("not alike").select("key")
        if not unlike.isEmpty():
            members = materialise(placed.join(unlike, "key"), "unlike")
            texts = maybe_needed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.hash(text).alias("t"), F.col(text).alias("body")), members.select(F.col("d").alias("doc_id")))
            hits = hits.unionByName(_parted_hits(texts.select(F.col("doc_id").alias("d"), "t", F.split("body", "\n").alias("lines")), members, min_documents))
        drops = materialise(hits.groupBy("d", "t").agg(F.collect_set("line").alias("drops")), "dropped-lines")
    # the input's other columns travel in one struct, so none of their names can clash
    marked = docs.select(F.struct(*[docs[f"`{c}`"] for c in own if c != text]).alias("row"), docs[f"`{doc_id}`"].cast("long").alias("d"), F.hash(docs[f"`{text}`"]).alias("t"), docs[f"`{text}`"].alias("body"))
    # a text is split if it loses lines, and once: parts is named twice below, so it is not worked out again for each line
    joined = marked.join(drops.hint("merge"), ["d", "t"], "left").withColumn("parts", F.when(F.col("drops").isNotNull(), F.split("body", "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("drops"))
    fresh = F.when(F.col("drops").isNull(), F.col("body")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("parts", i)), "\n"))
    feeds = F.octet_length("body") - F.octet_length(F.replace("body", F.lit("\n"), F.lit("")))
    return joined.select(
        *[(fresh if c == text else F.col("row").getField(c)).alias(c) for c in own],
        F.when(F.col("body").isNull(), 0).otherwise(feeds + 1).alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).alias("n_dropped"))


_CODES = " + ".join(f"greatest(0, unicode({c}))" for c in ("x", "substr(x, 3, 1)"))
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS content
  FROM documents WHERE doc_id IS NOT NULL),
clean AS (
  SELECT doc_id, line, string_split(replace(c, chr(9), ' '), ' ') AS t
  FROM (SELECT doc_id, line, regexp_replace(regexp_replace(content, '{EDGE}', '', 'g'), '{FIELD}', '<*>', 'g') AS c FROM lines) WHERE c <> ''),
bits AS (
  SELECT *, least(len(t), {PLACES}) AS size, CAST(list_sum([CASE WHEN (length(x) + {_CODES}) % 2 = 1 THEN CAST(1 AS BIGINT) << CAST(i - 1 AS INT) ELSE 0 END FOR x, i IN t[1:{PLACES}]]) AS BIGINT) AS b FROM clean),
keys AS (
  SELECT doc_id, line, size, b, '0 ' || len(t) || ' ' || array_to_string(t, ' ') AS key FROM bits
  UNION ALL
  SELECT doc_id, line, size, b, (c + 1) || ' ' || len(t) || ' ' || array_to_string([x FOR x, i IN t IF CASE WHEN len(t) >= {SHORT} THEN (i - 1) % {CLASSES} = c ELSE (i - 1) % {CLASSES} <> c END], ' ')
  FROM bits, range({CLASSES}) r(c) WHERE len(t) >= {WILD_FROM}),
recurring AS (SELECT key, min(doc_id) AS first FROM keys GROUP BY key HAVING count(DISTINCT doc_id) >= 5 AND max(size) - bit_count(xor(bit_and(b), bit_or(b))) >= {SIMILAR} * max(size)),
drops AS (SELECT DISTINCT doc_id, line FROM keys JOIN recurring USING (key) WHERE doc_id > first),
kept AS (
  SELECT l.doc_id, string_agg(content, chr(10) ORDER BY l.line) AS text FROM lines l LEFT JOIN drops d ON l.doc_id = d.doc_id AND l.line = d.line
  WHERE d.line IS NULL GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM drops GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS INTEGER) AS n_lines, CAST(coalesce(n.n, 0) AS INTEGER) AS n_dropped
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
