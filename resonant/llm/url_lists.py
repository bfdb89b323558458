"""Operator 3: temporal URL lists.

A list is a log of dated entries: from ``since`` on, ``pattern`` is listed
(``active``) or no longer listed. Entries become validity intervals, the next
entry of the same pattern ending the one before. Every capture is then joined
as of its fetch time to the intervals of the patterns that cover its URL: its
host, each parent domain, and its host with each leading part of the path.

Patterns that are in no list are dropped from the captures' side by a bitmap (sized
by the patterns, 32 MB at most) before anything is shuffled, so hosts that no entry names, however
many captures they hold, do not move; what is left is an equality join, which
adaptive execution splits where a pattern is hot.

Defined cases: patterns are taken in lower case, without scheme, ``www.``, port
or trailing slash; null or empty patterns and null dates are ignored; of entries of
one pattern and date an active one wins; a null URL or fetch time matches nothing
(blocked false); repeated captures are judged each; with no entries nothing is
blocked; all columns of the captures are kept, but for clashing names of the four
added ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ids import bitmap, bits_for, hits
from .scratch import materialise

ADDED = ("blocked", "matched_pattern", "matched_category", "listed_since")


def _plain(c):
    c = F.regexp_replace(F.lower(F.trim(c)), r"^[a-z][a-z0-9+.-]*://", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^(?:[^/@]*@)?(?:www\.)?", "")
    return F.regexp_replace(F.regexp_replace(c, r"^([^/:]*):[0-9]*", "$1"), r"/+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, category, since, until (null: still listed) from entries (pattern, category, since, active)."""
    one = entries.select(_plain(F.col("pattern")).alias("pattern"), "category", "since", F.coalesce("active", F.lit(True)).alias("active")).where("pattern <> '' and since is not null")
    one = one.groupBy("pattern", "since").agg(F.max(F.struct("active", "category")).alias("e"))
    until = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return one.select("pattern", F.col("e.category").alias("category"), "since", until.alias("until"), "e.active").where("active").drop("active")


def patterns_of(plain, labels_most: int, path_most: int):
    """The patterns that cover a normalised URL (a column, so that it is worked out once), of at most so many host labels and path parts."""
    none = F.array().cast("array<string>")
    host, path = F.split(plain, "/")[0], F.slice(F.split(plain, "/"), 2, max(1, path_most))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (labels_most - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.concat_ws("/", host, F.array_join(F.slice(path, F.lit(1), i), "/")))
    return F.array_distinct(F.when(plain == "", none).otherwise(F.concat(domains, F.when((F.size(path) > 0) & F.lit(path_most > 0), prefixes).otherwise(none))))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at", key: str = "page_id") -> DataFrame:
    """The captures with blocked, and the longest pattern that was listed when they were fetched.

    ``key`` names a capture; rows of equal key, URL and fetch time share a result.
    """
    listed = materialise(intervals(entries), "url-intervals")
    own = [c for c in captures.columns if c not in ADDED]
    # the captures' columns travel in one struct, so none of their names can clash
    row = F.struct(*[captures[f"`{c}`"] for c in own]).alias("row")
    rows = captures.select(row, captures[f"`{key}`"].alias("k"), captures[f"`{url}`"].cast("string").alias("u"), captures[f"`{fetched}`"].alias("f"))
    patterns = listed.select("pattern").distinct()
    # what is longer than every listed pattern cannot be one; so a very long URL makes no more candidates than that
    labels_most, path_most = patterns.agg(F.coalesce(F.max(F.size(F.split(F.split("pattern", "/")[0], r"\."))), F.lit(1)), F.coalesce(F.max(F.size(F.split("pattern", "/"))) - 1, F.lit(0))).first()
    asked = rows.select("k", "u", "f").where("u is not null and f is not null").withColumn("plain", _plain(F.col("u")))
    keys = asked.select("k", "u", "f", F.explode(patterns_of(F.col("plain"), labels_most, path_most)).alias("pattern"))
    bits = bits_for(patterns.count())
    if bits is not None:
        keys = hits(keys, "pattern", bitmap(patterns, "pattern", bits), bits).where("hit").drop("hit")
    met = keys.join(listed, "pattern").where("since <= f and (until is null or f < until)")
    best = met.groupBy("k", "u", "f").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "category", "since")).alias("m"))
    best = best.select(F.col("k").alias("k2"), F.col("u").alias("u2"), F.col("f").alias("f2"), "m")
    out = rows.join(best, F.col("k").eqNullSafe(F.col("k2")) & (F.col("u") == F.col("u2")) & (F.col("f") == F.col("f2")), "left")
    return out.select("row.*", F.col("m").isNotNull().alias("blocked"), F.col("m.pattern").alias("matched_pattern"), F.col("m.category").alias("matched_category"), F.col("m.since").alias("listed_since"))


# -- over the table `pages`: fetch times and a list by rule, since it has neither

_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:www\.)?([^/?#:]*)"
START = 1704067200  # 2024-01-01, seconds


def captures_of(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch time within 2024 by rule."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(START) + F.pmod(F.col("page_id") * 7919 * 60, F.lit(366 * 86400))).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Listed hosts and host/language paths by rule: by the host's digest, some are listed and, later, taken off and listed again."""
    host = F.lower(F.regexp_extract("url", _HOST, 1))
    hosts = pages.where("url is not null").select(host.alias("host")).where("host <> ''").distinct()
    digit = lambda i, n: F.conv(F.substring(F.md5("host"), i, n), 16, 10).cast("long")
    chosen = hosts.select("host", digit(1, 2).alias("a"), digit(3, 2).alias("b"), digit(5, 2).alias("c")).where("a < 64")
    day = lambda d: F.timestamp_seconds(F.lit(START) + d * 86400)
    pattern = F.when(F.col("a") % 4 == 0, F.concat("host", F.lit("/en"))).when(F.col("a") % 4 == 1, F.regexp_replace("host", r"^[^.]*\.", "")).otherwise(F.col("host"))
    states = F.array(*[F.struct(day(d).alias("since"), F.lit(on).alias("active")) for d, on in ((F.col("b"), True), (F.col("b") + F.col("c"), False), (F.col("b") + F.col("c") + 60, True))])
    return chosen.select(pattern.alias("pattern"), F.concat(F.lit("c"), F.col("b") % 3).alias("category"), F.explode(states).alias("s")).select("pattern", "category", "s.since", "s.active")


ORACLE = rf"""
WITH hosts AS (SELECT DISTINCT lower(regexp_extract(url, '{_HOST}', 1)) AS host FROM pages WHERE url IS NOT NULL),
chosen AS (
  SELECT host, a, b, c FROM (SELECT host, ('0x' || md5(host)[1:2])::BIGINT AS a, ('0x' || md5(host)[3:4])::BIGINT AS b, ('0x' || md5(host)[5:6])::BIGINT AS c FROM hosts WHERE host <> '') WHERE a < 64),
entries AS (
  SELECT CASE WHEN a % 4 = 0 THEN host || '/en' WHEN a % 4 = 1 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host END AS pattern, 'c' || (b % 3) AS category, x.d AS since, x.active
  FROM chosen, LATERAL (VALUES (b, true), (b + c, false), (b + c + 60, true)) x(d, active)),
one AS (SELECT pattern, since, max(struct_pack(active := active, category := category)) AS e FROM entries GROUP BY pattern, since),
listed AS (
  SELECT pattern, e.category AS category, {START} + since * 86400 AS since, {START} + 86400 * lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until, e.active AS active FROM one),
captures AS (
  SELECT page_id, url, {START} + (page_id * 7919 * 60) % (366 * 86400) AS f,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://', ''), '[?#].*$', ''), '^(?:[^/@]*@)?(?:www\.)?', ''), '^([^/:]*):[0-9]*', '\1'), '/+$', '') AS plain FROM pages),
best AS (
  SELECT page_id, max(struct_pack(n := length(pattern), p := pattern, c := category, s := since)) AS m FROM captures JOIN listed
  ON listed.active AND since <= f AND (until IS NULL OR f < until)
    AND (string_split(plain, '/')[1] = pattern OR ends_with(string_split(plain, '/')[1], '.' || pattern) OR plain = pattern OR (contains(pattern, '/') AND starts_with(plain, pattern || '/')))
  GROUP BY page_id)
SELECT c.page_id, c.url, m IS NOT NULL AS blocked, m.p AS matched_pattern, m.c AS matched_category, CAST(m.s AS BIGINT) AS listed_since FROM captures c LEFT JOIN best USING (page_id)
"""
