"""Queries of the relational operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import nan
from ..functions.hashing import hash_order, md5_mod
from ..operators import relational as R
from .catalog import query

FULL, REDUCED, REDUCED_D = ["AFRICA", "ASIA"], ["AMERICA", "EUROPE"], [15.0, 120.0]
MD5 = "('0x' || md5({})[{}:{}])::BIGINT"


def _mod(expr: str, n: int) -> str:
    """md5(expr) mod n in SQL, part by part."""
    out = "0"
    for at in (1, 9, 17, 25):
        out = f"(({out} * {4294967296 % n} + {MD5.format(expr, at, at + 7)}) % {n})"
    return out


# -- scans


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def scan_done_records(t):
    return t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT DISTINCT o_custkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'not_applicable' END AS state FROM orders WHERE o_orderstatus IN ('F', 'P')")
def resume_key_sets(t):
    state = F.when(F.col("o_orderstatus") == "F", "done").otherwise("not_applicable")
    return t.orders.where(F.col("o_orderstatus").isin("F", "P")).select("o_custkey", "o_orderpriority", state.alias("state")).distinct()


@query(r"SELECT page_id, url, lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM pages WHERE regexp_matches(lower(url), '\.(html|htm|pdf)$')")
def filter_by_extension(t):
    return t.pages.where(F.lower("url").rlike(r"\.(html|htm|pdf)$")).select("page_id", "url", F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"))


@query("SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'compute' ELSE 'cached' END AS route FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def embedding_cache_lookup(t):
    docs, labels = t.documents.select("doc_id"), t.labels.select(F.col("doc_id").alias("hit"), "quality")
    return docs.join(labels, docs.doc_id == labels.hit, "left").select("doc_id", "quality", F.when(F.col("hit").isNull(), "compute").otherwise("cached").alias("route"))


# -- sinks


@query("SELECT event_type, count(*) AS n, round(20 * log10(greatest(max(abs(value)), 1e-12)), 6) AS peak_dbfs, round(20 * log10(greatest(sqrt(avg(value * value)), 1e-12)), 6) AS rms_dbfs FROM events GROUP BY 1")
def signal_levels(t):
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(nan.dbfs(F.max(F.abs("value"))), 6).alias("peak_dbfs"),
        F.round(nan.dbfs(F.sqrt(F.avg(F.col("value") * F.col("value")))), 6).alias("rms_dbfs"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', 'cache/'), '(\.[A-Za-z0-9]+)?([?#].*)?$', '.npy') AS path FROM pages")
def cache_path_rewrite(t):
    path = F.regexp_replace("url", r"^[a-z]+://[^/]*/", "cache/")
    # the pattern also matches the empty end, so the tail is cut first and the suffix added once
    return t.pages.select("page_id", F.concat(F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"\.[A-Za-z0-9]+$", ""), F.lit(".npy")).alias("path"))


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) <= 3 AS keep FROM orders")
def retention_first_k_per_cell(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    # the ranking is limited before and after its shuffle, and only the k rows of each cell are joined back
    kept = R.first_k(rows, ["o_orderpriority", "o_orderstatus"], [F.col("o_orderkey")], 3).select("o_orderkey", F.lit(True).alias("kept"))
    return rows.join(kept, "o_orderkey", "left").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.coalesce("kept", F.lit(False)).alias("keep"))


# -- filters


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 'nan'::DOUBLE) AS k, coalesce(CAST(json_extract_string(props, '$.a.b') AS DOUBLE), 'nan'::DOUBLE) AS missing FROM events")
def nested_get_default(t):
    return t.events.select("event_id", nan.or_nan(F.get_json_object("props", "$.k")).alias("k"), nan.or_nan(F.get_json_object("props", "$.a.b")).alias("missing"))


@query("SELECT event_type, count(x) AS n, round(avg(x), 6) AS mean FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN NULL ELSE value END AS x FROM events) GROUP BY 1")
def finite_mean(t):
    raw = F.when(F.col("event_id") % 7 == 0, nan.NAN).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value"))
    x = nan.finite_or_null(F.col("x"))
    return t.events.select("event_type", raw.alias("x")).groupBy("event_type").agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"))


@query("SELECT p_partkey, p_brand, p_size, CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size > 20 THEN 'not_applicable' ELSE 'planned' END AS status, CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size > 20 THEN 'size ' || p_size || ' above native 20' END AS reason FROM part")
def plan_not_applicable(t):
    over = F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13") & (F.col("p_size") > 20)
    return t.part.select("p_partkey", "p_brand", "p_size", F.when(over, "not_applicable").otherwise("planned").alias("status"),
                         F.when(over, F.concat(F.lit("size "), F.col("p_size"), F.lit(" above native 20"))).alias("reason"))


@query("SELECT a.event_type AS left_type, b.event_type AS right_type, NOT (a.hi < b.lo OR b.hi < a.lo) AS overlap FROM (SELECT event_type, avg(value) - 1.96::DOUBLE * stddev_samp(value) / sqrt(count(*)) AS lo, avg(value) + 1.96::DOUBLE * stddev_samp(value) / sqrt(count(*)) AS hi FROM events GROUP BY 1) a, (SELECT event_type, avg(value) - 1.96::DOUBLE * stddev_samp(value) / sqrt(count(*)) AS lo, avg(value) + 1.96::DOUBLE * stddev_samp(value) / sqrt(count(*)) AS hi FROM events GROUP BY 1) b WHERE a.event_type < b.event_type")
def ci_overlap_pairs(t):
    from ..functions.stats import overlap

    half = 1.96 * F.stddev_samp("value") / F.sqrt(F.count("*").cast("double"))
    ci = t.events.groupBy("event_type").agg((F.avg("value") - half).alias("lo"), (F.avg("value") + half).alias("hi"))
    a, b = ci.alias("a"), ci.alias("b")
    return a.join(b, F.col("a.event_type") < F.col("b.event_type")).select(
        F.col("a.event_type").alias("left_type"), F.col("b.event_type").alias("right_type"), overlap(F.col("a.lo"), F.col("a.hi"), F.col("b.lo"), F.col("b.hi")).alias("overlap"))


# -- joins


_PLAN = """
SELECT r_name AS model, d AS duration_s, n_name AS prompt, CAST(s AS INTEGER) AS set_idx, CAST(k AS INTEGER) AS track_idx,
  20260904 + 100000 * s + 1000 * n_nationkey + k AS seed
FROM region, (VALUES (15.0::DOUBLE), (30.0::DOUBLE), (120.0::DOUBLE)) v(d), nation, range(5) a(s), range(4) b(k)
WHERE s < CASE WHEN r_name IN ('AMERICA', 'EUROPE') AND d IN (15.0, 120.0) THEN 3 WHEN r_name IN ('AFRICA', 'ASIA') THEN 5 ELSE 4 END
"""


def plan(t):
    models = t.region.select(F.col("r_name").alias("model"))
    durations = t.spark.createDataFrame([(15.0,), (30.0,), (120.0,)], "duration_s double")
    prompts = t.nation.select(F.col("n_name").alias("prompt"), F.col("n_nationkey").alias("prompt_idx"))
    k = R.replicates_for(F.col("model"), F.col("duration_s"), FULL, REDUCED, REDUCED_D, 5, 3, 4)
    rows = R.plan_runs(models, durations, prompts, k, 4)
    return rows.select("model", "duration_s", "prompt", "set_idx", "track_idx", R.make_seed(20260904, F.col("set_idx"), F.col("prompt_idx"), F.col("track_idx")).alias("seed"))


@query(_PLAN)
def plan_cross_product(t):
    return plan(t)


@query("SELECT DISTINCT r_name AS model, d AS duration_s, CASE WHEN r_name IN ('AMERICA', 'EUROPE') AND d IN (15.0, 120.0) THEN 3 WHEN r_name IN ('AFRICA', 'ASIA') THEN 5 ELSE 4 END AS k FROM region, (VALUES (15.0::DOUBLE), (30.0::DOUBLE), (120.0::DOUBLE)) v(d)")
def plan_replicates(t):
    durations = t.spark.createDataFrame([(15.0,), (30.0,), (120.0,)], "duration_s double")
    cells = t.region.select(F.col("r_name").alias("model")).crossJoin(F.broadcast(durations))
    return cells.select("model", "duration_s", R.replicates_for(F.col("model"), F.col("duration_s"), FULL, REDUCED, REDUCED_D, 5, 3, 4).alias("k"))


@query("SELECT l_orderkey, l_linenumber, 20260904 + 100000 * l_linenumber + 1000 * (l_suppkey % 100) + l_orderkey % 1000 AS seed FROM lineitem")
def seed_arithmetic(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", R.make_seed(20260904, F.col("l_linenumber"), F.col("l_suppkey") % 100, F.col("l_orderkey") % 1000).alias("seed"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def resume_anti_join(t):
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.pending(t.orders.select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("SELECT c_custkey, c_nationkey FROM customer c WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s.s_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def set_semi_anti(t):
    ready = t.supplier.where("s_acctbal > 0").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    todo = t.customer.select("c_custkey", "c_nationkey").join(ready, "c_nationkey", "left_semi")
    return R.pending(todo, t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, n_name AS prompt_text FROM customer JOIN nation ON c_nationkey = n_nationkey")
def prompt_lookup_join(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("prompt_text"))


@query("SELECT t.c_mktsegment AS model, t.c_nationkey AS cell, t.n, s.m FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL) t LEFT JOIN (SELECT s_nationkey, count(*) AS m FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL) s ON t.c_nationkey = s.s_nationkey")
def cell_left_join(t):
    tracks = t.customer.groupBy(F.col("c_mktsegment").alias("model"), F.col("c_nationkey").alias("cell")).agg(F.count("*").alias("n"))
    dist = t.supplier.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("cell")).agg(F.count("*").alias("m"))
    return tracks.join(dist, "cell", "left").select("model", "cell", "n", "m")


@query("SELECT floor_key, n, round(price, 6) AS price, floors FROM (SELECT o_orderpriority AS floor_key, count(*) AS n, avg(o_totalprice) AS price FROM orders GROUP BY 1) a JOIN (SELECT o_orderpriority AS k, string_agg(f, '; ' ORDER BY f) AS floors FROM (SELECT o_orderpriority, o_orderstatus || ': ' || count(*) AS f FROM orders GROUP BY o_orderpriority, o_orderstatus) GROUP BY 1) b ON a.floor_key = b.k")
def floor_join(t):
    cells = t.orders.groupBy(F.col("o_orderpriority").alias("floor_key")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("price"))
    each = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.concat(F.col("o_orderstatus"), F.lit(": "), F.count("*")).alias("f"))
    floors = each.groupBy(F.col("o_orderpriority").alias("floor_key")).agg(F.array_join(F.array_sort(F.collect_list("f")), "; ").alias("floors"))
    return cells.join(floors, "floor_key")


@query("SELECT e.event_id, e.user_id, o.o_orderkey FROM (SELECT event_id, user_id, epoch_us(ts) / 1000000.0::DOUBLE AS s FROM events) e JOIN (SELECT o_custkey, o_orderkey, CAST(1704067200 + (o_orderkey % 30) * 86400 AS DOUBLE) AS lo, CAST(1704067200 + (o_orderkey % 30) * 86400 + 43200 AS DOUBLE) AS hi FROM orders) o ON e.user_id = o.o_custkey AND s >= lo AND s < hi")
def range_join_loop_window(t):
    points = t.events.select("event_id", F.col("user_id").alias("k"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    lo = (F.lit(1704067200) + F.pmod("o_orderkey", F.lit(30)) * 86400).cast("double")
    spans = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", lo.alias("lo"), (lo + 43200).alias("hi"))
    return R.half_open_join(points, spans, ["k"], "s", "lo", "hi").select("event_id", F.col("k").alias("user_id"), "o_orderkey")


@query("WITH m AS (SELECT c_mktsegment AS model, c_nationkey AS prompt, avg(c_acctbal) AS x FROM customer GROUP BY ALL), p AS (SELECT prompt, median(x) AS med FROM m GROUP BY 1) SELECT model, count(*) AS n, count(*) FILTER (x > med) AS above, count(*) FILTER (x > med) >= 0.5 * count(*) AS ok FROM m JOIN p USING (prompt) GROUP BY 1")
def above_peer_median(t):
    m = t.customer.groupBy(F.col("c_mktsegment").alias("model"), F.col("c_nationkey").alias("prompt")).agg(F.avg("c_acctbal").alias("x"))
    p = m.groupBy("prompt").agg(F.median("x").alias("med"))
    above = F.count_if(nan.above(F.col("x"), F.col("med")))
    return m.join(p, "prompt").groupBy("model").agg(F.count("*").alias("n"), above.alias("above"), (above >= 0.5 * F.count("*")).alias("ok"))


# -- windows over rows


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(t):
    return R.latest_per_key(t.events.select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id", "value")


# -- grouped aggregates


@query("SELECT l_returnflag, l_linestatus, l_linenumber % 5 AS set_idx, count(*) AS n_files, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY ALL")
def set_sizes(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 5).alias("set_idx")).agg(F.count("*").alias("n_files"), F.countDistinct("l_orderkey").alias("n_orders"))


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_quantity > 25) AS a, count(*) FILTER (l_discount <= 0.05) AS b, count(*) FILTER (l_quantity > 25 AND l_discount <= 0.05) AS both FROM lineitem GROUP BY 1")
def conditional_pass_counts(t):
    a, b = F.col("l_quantity") > 25, F.col("l_discount") <= 0.05
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if(a & b).alias("both"))


@query("SELECT l_returnflag, reason, count(*) AS n FROM (SELECT l_returnflag, unnest(list_filter([CASE WHEN l_quantity < 5 THEN 'silent_output' END, CASE WHEN l_discount > 0.08 THEN 'mostly_silence' END, CASE WHEN l_tax > 0.06 THEN 'noise_like' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem) GROUP BY ALL")
def reason_histogram(t):
    why = F.array_compact(F.array(F.when(F.col("l_quantity") < 5, "silent_output"), F.when(F.col("l_discount") > 0.08, "mostly_silence"), F.when(F.col("l_tax") > 0.06, "noise_like")))
    return t.lineitem.select("l_returnflag", F.explode(why).alias("reason")).groupBy("l_returnflag", "reason").agg(F.count("*").alias("n"))


@query("SELECT cell, round(avg(m), 6) AS mean_of_means, count(*) AS prompts FROM (SELECT l_returnflag AS cell, l_linenumber AS prompt, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL) GROUP BY 1")
def mean_by_subgroup(t):
    each = t.lineitem.groupBy(F.col("l_returnflag").alias("cell"), F.col("l_linenumber").alias("prompt")).agg(F.avg("l_extendedprice").alias("m"))
    return each.groupBy("cell").agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.count("*").alias("prompts"))


@query("SELECT event_type, round(quantile_cont(value, 0.01::DOUBLE), 6) AS p01, round(median(value), 6) AS p50, round(quantile_cont(value, 0.95::DOUBLE), 6) AS p95, round(quantile_cont(value, 0.99::DOUBLE), 6) AS p99 FROM events GROUP BY 1")
def exact_percentiles(t):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return t.events.groupBy("event_type").agg(p(0.01).alias("p01"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query("SELECT event_type, round(stddev_pop(value) / (avg(value) + 1e-8), 6) AS cv, round(stddev_samp(value), 6) AS s FROM events GROUP BY 1")
def coefficient_of_variation(t):
    return t.events.groupBy("event_type").agg(F.round(F.stddev_pop("value") / (F.avg("value") + 1e-8), 6).alias("cv"), F.round(F.stddev_samp("value"), 6).alias("s"))


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def distinct_sources(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query(r"SELECT CASE WHEN regexp_matches(url, '\.[A-Za-z0-9]+$') THEN lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) ELSE '' END AS ext, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1 ORDER BY bytes DESC, ext")
def size_by_extension(t):
    ext = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1))
    return t.pages.groupBy(ext.alias("ext")).agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).cast("long").alias("bytes")).orderBy(F.desc("bytes"), "ext")


@query("SELECT o_orderpriority AS model, count(*) AS runs, max(o_totalprice) FILTER (o_orderstatus <> 'P') AS peak, round(avg(o_totalprice) FILTER (o_orderstatus <> 'P'), 6) AS mean, bool_or(o_orderstatus = 'P') AS any_failed FROM orders GROUP BY 1")
def ok_run_stats(t):
    ok = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return t.orders.groupBy(F.col("o_orderpriority").alias("model")).agg(F.count("*").alias("runs"), F.max(ok).alias("peak"), F.round(F.avg(ok), 6).alias("mean"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_failed"))


# -- sampling and limits


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 300")
def limit_per_group(t):
    return R.first_k(t.part.select("p_brand", "p_partkey"), ["p_brand"], [F.col("p_partkey")], 300)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 3")
def sample_cap_per_group(t):
    return R.cap_per_group(t.documents.select("source", "doc_id"), "source", "doc_id", 3, seed=7)


@query("SELECT doc_id, source FROM documents ORDER BY md5('11|' || doc_id), doc_id LIMIT 100")
def sample_global(t):
    return R.sample_rows(t.documents.select("doc_id", "source"), 100, seed=11, key="doc_id", order=["doc_id"])


@query("SELECT c_custkey, row_number() OVER (ORDER BY md5('3|' || c_custkey), c_custkey) AS place FROM customer")
def hash_shuffle_prefix(t):
    """A seeded full shuffle: the places of all rows. Parts are hash prefixes, as long as keeps a part near 100,000 rows; only their counts meet."""
    keys = t.customer.select("c_custkey", hash_order(3, F.col("c_custkey")).alias("h"))
    digits = keys.agg(F.greatest(F.lit(1), F.ceil(F.log(16.0, F.greatest(F.count("*"), F.lit(1)) / 1e5))).cast("int").alias("digits"))  # one row
    ordered = keys.crossJoin(F.broadcast(digits)).select("c_custkey", "h", F.expr("substring(h, 1, digits)").alias("part"))
    before = ordered.groupBy("part").agg(F.count("*").alias("n"))
    start = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each 100,000
    before = before.select("part", F.coalesce(start, F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("h", "c_custkey"))
    return ordered.withColumn("own", own).join(before, "part").select("c_custkey", (F.col("start") + F.col("own")).alias("place"))


# -- set operations


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def key_union(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity < 30 UNION SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 20")
def shard_union_dedup(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey"]
    return R.union_exact(t.lineitem.where("l_quantity < 30").select(*cols), t.lineitem.where("l_quantity >= 20").select(*cols))


@query(f"SELECT CAST({_mod('o_orderpriority || chr(124) || o_orderstatus', 4)} AS BIGINT) AS shard, count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders GROUP BY 1")
def shard_cover_once(t):
    key = F.concat_ws("|", "o_orderpriority", "o_orderstatus")
    return t.orders.groupBy(md5_mod(key, 4).alias("shard")).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"))


@query(f"SELECT c_custkey, CAST({_mod('c_mktsegment || chr(124) || c_custkey', 7)} AS BIGINT) AS shard FROM customer")
def hash_shard(t):
    return t.customer.select("c_custkey", R.shard_of(F.concat_ws("|", "c_mktsegment", "c_custkey"), 7).alias("shard"))


@query(f"SELECT doc_id, source, CAST({_mod('source', 2)} AS BIGINT) AS half FROM documents")
def split_half_by_source(t):
    return t.documents.select("doc_id", "source", md5_mod(F.col("source"), 2).alias("half"))


# -- scalars


@query("SELECT l_orderkey, l_linenumber, round(abs(r - round_even(r, 0)), 6) AS err FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS r FROM lineitem)")
def integer_distance(t):
    r = F.col("l_extendedprice") / 1000
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.abs(r - F.rint(r)), 6).alias("err"))


def octave_fold(local, reference):
    """The local tempo brought within half an octave of the reference; unchanged where either is not positive."""
    r = local / reference
    down = local / F.pow(F.lit(2.0), F.ceil(F.log2(r) - 0.5))
    up = local * F.pow(F.lit(2.0), F.ceil(-0.5 - F.log2(r)))
    return F.when((local <= 0) | (reference <= 0), local).when(r > 2**0.5, down).when(r < 2**-0.5, up).otherwise(local)


@query("SELECT event_id, round(CASE WHEN value <= 0 THEN value WHEN value / 20 > sqrt(2) THEN value / pow(2, ceil(log2(value / 20) - 0.5)) WHEN value / 20 < 1 / sqrt(2) THEN value * pow(2, ceil(-0.5 - log2(value / 20))) ELSE value END, 6) AS folded FROM events")
def octave_fold_values(t):
    return t.events.select("event_id", F.round(octave_fold(F.col("value"), F.lit(20.0)), 6).alias("folded"))


@query("SELECT page_id, printf('%s_%ds_%05d', regexp_replace(url, '^.*/', ''), CAST(page_id % 90 AS INTEGER), CAST(page_id AS INTEGER)) AS name, 'audio/' || (page_id % 5) || '/' || page_id || '.wav' AS path, CAST(ceil(strlen(html) / 5.12::DOUBLE) AS BIGINT) AS clips FROM pages")
def name_formatting(t):
    stem = F.regexp_replace("url", "^.*/", "")
    return t.pages.select("page_id", F.format_string("%s_%ds_%05d", stem, F.col("page_id") % 90, F.col("page_id")).alias("name"),
                          F.concat_ws("/", F.lit("audio"), F.col("page_id") % 5, F.concat("page_id", F.lit(".wav"))).alias("path"),
                          F.ceil(F.octet_length("html") / F.lit(5.12)).cast("long").alias("clips"))
