"""Queries of the report of a run: cells, verdicts, and the control of runs, over a table of reports.

``orders`` stand in for tracks: a model for each priority, three durations, six prompts, and measures by arithmetic
of the order's key, some of them missing, undefined or degenerate.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import bootstrap as B
from ..operators import runs
from ..operators import summary as S
from .catalog import query
from .stats_queries import Z

RESAMPLES = 40


def reports(t):
    u = lambda k: (F.col("o_orderkey") * k % 997) / 997.0
    by = lambda n: F.col("o_orderkey") % n == 0
    grid = lambda a, b, c: F.struct((u(a) * 0.18).alias("seam_gap_beat_error"), (u(b) * 0.14).alias("bar_fraction_error"), by(c).alias("degenerate"))
    lift = F.when(F.col("o_orderpriority") == "1-URGENT", 0.2).otherwise(0.0)
    reasons = F.array_compact(F.array(F.when(by(31), "silent_output"), F.when(by(29), "noise_like")))
    game = F.struct(
        (u(7) < 0.5 + 3 * lift).alias("seam_naive_ok"), F.struct(F.when(by(43), float("nan")).otherwise(u(29) * 2).alias("seam_score")).alias("seam_50ms"), F.struct((u(31) * 2).alias("seam_score")).alias("seam_200ms"),
        F.struct(u(37).alias("best_seam_score"), (u(41) * 15).alias("loop_duration_s"), (u(11) < 0.8).alias("best_seam_ok_p95")).alias("best_loop"),
        grid(13, 17, 41).alias("grid_naive"), grid(19, 23, 47).alias("grid_best_loop"))
    return t.orders.select(
        F.col("o_orderpriority").alias("model_id"), F.element_at(F.array(F.lit(15.0), F.lit(30.0), F.lit(60.0)), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("duration_s"),
        F.concat(F.lit("p"), F.col("o_custkey") % 6).alias("prompt_id"), F.when(F.col("o_custkey") % 6 == 5, False).when(F.col("o_custkey") % 6 < 4, True).alias("loop_eval"),
        F.col("o_orderkey").alias("track"), F.struct((F.size(reasons) > 0).alias("degenerate"), reasons.alias("reasons")).alias("degeneracy"), F.when(~by(37), game).alias("game"),
        F.struct((u(43) * 3).alias("regularity_ratio"), F.when(by(5), float("nan")).otherwise(u(47)).alias("tempo_cv"), u(53).alias("key_drift_fraction")).alias("structure"),
        (u(59) * 60).alias("actual_duration_s"), F.when(~by(7), u(61) + lift).alias("clap_score"))


def _u(k):
    return f"((o_orderkey * {k} % 997) / 997.0::DOUBLE)"


_LIFT = "(CASE WHEN o_orderpriority = '1-URGENT' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)"
REPORTS = f"""tracks AS (SELECT o_orderpriority AS model_id, [15.0::DOUBLE, 30.0::DOUBLE, 60.0::DOUBLE][o_orderkey % 3 + 1] AS duration_s, 'p' || (o_custkey % 6) AS prompt_id,
  o_orderkey AS track, o_custkey % 6 <> 5 AND o_orderkey % 37 <> 0 AS loops, o_orderkey % 31 = 0 AS silent, o_orderkey % 29 = 0 AS noisy, o_orderkey % 31 = 0 OR o_orderkey % 29 = 0 AS deg,
  {_u(7)} < 0.5::DOUBLE + 3 * {_LIFT} AS seam_naive, {_u(11)} < 0.8::DOUBLE AS seam_best,
  o_orderkey % 41 <> 0 AND {_u(13)} * 0.18::DOUBLE <= 0.1::DOUBLE AND {_u(17)} * 0.14::DOUBLE <= 0.1::DOUBLE AS grid_naive,
  o_orderkey % 47 <> 0 AND {_u(19)} * 0.18::DOUBLE <= 0.1::DOUBLE AND {_u(23)} * 0.14::DOUBLE <= 0.1::DOUBLE AS grid_best,
  CASE WHEN o_orderkey % 43 <> 0 THEN {_u(29)} * 2 END AS seam_score_50ms, {_u(31)} * 2 AS seam_score_200ms, {_u(37)} AS best_seam_score, {_u(41)} * 15 AS best_loop_duration_s,
  {_u(13)} * 0.18::DOUBLE AS seam_gap_beat_error_naive, {_u(17)} * 0.14::DOUBLE AS bar_fraction_error_naive, {_u(43)} * 3 AS regularity, CASE WHEN o_orderkey % 5 <> 0 THEN {_u(47)} END AS tempo_cv,
  {_u(53)} AS key_drift, {_u(59)} * 60 AS actual_duration_s, CASE WHEN o_orderkey % 7 <> 0 THEN {_u(61)} + {_LIFT} END AS clap FROM orders)"""


def _wilson(k, n, which):
    z, m = f"{Z!r}::DOUBLE", f"({n})::DOUBLE"
    mid, half = f"(({k} / {m}) + {z} * {z} / (2 * {m})) / (1 + {z} * {z} / {m})", f"{z} * sqrt(({k} / {m}) * (1 - {k} / {m}) / {m} + {z} * {z} / (4 * {m} * {m})) / (1 + {z} * {z} / {m})"
    return {"p": f"{k} / {m}", "lo": f"{mid} - {half}", "hi": f"{mid} + {half}"}[which]


_SHARES = {f"{what}_pass_{v}": {"seam": f"loops AND NOT deg AND seam_{v}", "grid": f"loops AND NOT deg AND grid_{v}", "seam_and_grid": f"loops AND NOT deg AND seam_{v} AND grid_{v}"}[what]
           for v in S.VARIANTS for what in ("seam", "grid", "seam_and_grid")}
_COUNTS = "counts AS (SELECT model_id, duration_s, count(*) AS n_tracks, count(*) FILTER (loops) AS n_loop_tracks, count(*) FILTER (deg) AS n_deg, " + ", ".join(f"count(*) FILTER ({c}) AS k_{n}" for n, c in _SHARES.items()) + " FROM tracks GROUP BY ALL)"
_SHARES_OUT = ", ".join(f"round({_wilson('n_deg', 'n_tracks', w)}, 6) AS degenerate_{w}" for w in ("p", "lo", "hi")) + ", " + ", ".join(f"round({_wilson(f'k_{n}', 'n_loop_tracks', w)}, 6) AS {n}_{w}" for n in _SHARES for w in ("p", "lo", "hi"))


@query(f"WITH {REPORTS}, {_COUNTS} SELECT model_id, duration_s, n_tracks, n_loop_tracks, {_SHARES_OUT} FROM counts")
def cell_summary(t):
    rows = S.cell_proportions(reports(t))
    names = ["degenerate", *_SHARES]
    return rows.select(*S.CELL, "n_tracks", "n_loop_tracks", *[F.round(f"{n}.{f}", 6).alias(f"{n}_{w}") for n in names for f, w in (("p", "p"), ("ci_lo", "lo"), ("ci_hi", "hi"))])


_OWN = {n: (f"CASE WHEN loops THEN {n} END" if own else n) for n, (_, own) in S.MEANS.items()}
_FLAT = "SELECT model_id || '|' || duration_s AS cell, model_id, duration_s, track, " + ", ".join(f"{e} AS v_{n}" for n, e in _OWN.items()) + " FROM tracks"


@query(f"""WITH {REPORTS}, flat AS ({_FLAT}), w AS ({B.weights_sql('SELECT * FROM flat', 'cell', 'track', RESAMPLES)}),
boot AS (SELECT model_id, duration_s, b, {', '.join(f'sum(v_{n} * w) / sum(w) FILTER (v_{n} IS NOT NULL) AS {n}' for n in S.MEANS)} FROM w GROUP BY ALL),
ci AS (SELECT model_id, duration_s, {', '.join(f'quantile_cont({n}, 0.025::DOUBLE) AS lo_{n}, quantile_cont({n}, 0.975::DOUBLE) AS hi_{n}' for n in S.MEANS)} FROM boot GROUP BY ALL),
pt AS (SELECT model_id, duration_s, {', '.join(f'avg(v_{n}) AS p_{n}, count(v_{n}) AS n_{n}' for n in S.MEANS)} FROM flat GROUP BY ALL)
SELECT model_id, duration_s, {', '.join(f'round(p_{n}, 6) AS {n}, round(lo_{n}, 6) AS {n}_lo, round(hi_{n}, 6) AS {n}_hi, n_{n} AS {n}_n' for n in S.MEANS)} FROM pt JOIN ci USING (model_id, duration_s)""")
def cell_mean_intervals(t):
    rows = S.cell_means(reports(t), ["track"], RESAMPLES)
    r = lambda n, f, a: F.round(f"{n}.{f}", 6).alias(a)
    return rows.select(*S.CELL, *[c for n in S.MEANS for c in (r(n, "point", n), r(n, "ci_lo", f"{n}_lo"), r(n, "ci_hi", f"{n}_hi"), F.col(f"{n}.n_observations").alias(f"{n}_n"))])


@query(f"WITH {REPORTS} SELECT model_id, duration_s, reason, count(*) AS n FROM (SELECT *, unnest(list_filter([CASE WHEN silent THEN 'silent_output' END, CASE WHEN noisy THEN 'noise_like' END], lambda x: x IS NOT NULL)) AS reason FROM tracks) GROUP BY ALL")
def cell_reasons(t):
    return S.cell_reasons(reports(t))


@query(f"WITH {REPORTS} SELECT model_id, duration_s, prompt_id, round(avg(clap), 6) AS clap FROM tracks WHERE clap IS NOT NULL GROUP BY ALL")
def prompt_scores(t):
    return S.prompt_means(reports(t)).withColumn("clap", F.round("clap", 6))


_VERDICTS = f"""{REPORTS}, {_COUNTS}, m AS (SELECT model_id, duration_s, prompt_id, avg(clap) AS clap FROM tracks WHERE clap IS NOT NULL GROUP BY ALL),
med AS (SELECT duration_s, prompt_id, median(clap) AS med FROM m GROUP BY ALL),
above AS (SELECT model_id, duration_s, count(*) FILTER (clap > med) >= 0.5 * count(*) AS ok FROM m JOIN med USING (duration_s, prompt_id) GROUP BY ALL),
x AS ({' UNION ALL '.join(f"SELECT model_id, duration_s, '{v}' AS variant, {_wilson(f'k_seam_pass_{v}', 'n_loop_tracks', 'lo')} >= 0.5 AS seam, {_wilson(f'k_grid_pass_{v}', 'n_loop_tracks', 'lo')} >= 0.5 AS grid FROM counts" for v in S.VARIANTS)}),
v AS (SELECT x.*, coalesce(ok, false) AS clap, seam AND grid AND coalesce(ok, false) AS pass FROM x LEFT JOIN above USING (model_id, duration_s))"""


@query(f"WITH {_VERDICTS} SELECT model_id || '|' || duration_s || '|' || variant AS verdict_key, *, CASE WHEN (SELECT bool_or(pass) FROM v) THEN 2 ELSE 1 END AS branch FROM v")
def decision_rule(t):
    """The verdicts of every model, duration and variant, and the branch that follows."""
    return S.decide(reports(t))


@query(f"WITH {REPORTS} SELECT track, loops AND NOT deg AND seam_naive AS seam_naive, loops AND NOT deg AND seam_best AS seam_best, loops AND NOT deg AND grid_naive AS grid_naive, loops AND NOT deg AND grid_best AS grid_best FROM tracks WHERE loops")
def loop_conditions(t):
    """Seam and grid of every track that loops, by variant."""
    return reports(t).where(S.loops()).select("track", *[f(v).alias(f"{n}_{v}") for v in S.VARIANTS for n, f in (("seam", S.seam_passes), ("grid", S.grid_passes))])


@query("""WITH s AS (SELECT o_orderpriority AS model_id, 30.0::DOUBLE AS duration_s, o_custkey % 5 AS i, avg(o_totalprice) / 1000 AS fad, avg(o_custkey) / 100 AS kad, quantile_cont(o_totalprice, 0.4::DOUBLE) / 1000 AS flo, quantile_cont(o_totalprice, 0.6::DOUBLE) / 1000 AS fhi, min(o_custkey) / 100 AS klo, max(o_custkey) / 100 AS khi FROM orders GROUP BY ALL),
l AS (SELECT model_id, duration_s, i, 'fad' AS metric, fad AS v, flo AS lo, fhi AS hi FROM s UNION ALL SELECT model_id, duration_s, i, 'kad', kad, klo, khi FROM s),
b AS (SELECT model_id, duration_s, metric, avg(v) AS mean, count(*) AS k, avg(lo) AS lo, avg(hi) AS hi, """ + f"{stats.t_quantile(4)!r}::DOUBLE" + """ * stddev_samp(v) / sqrt(count(*)) AS half FROM l GROUP BY ALL)
SELECT model_id, metric, round(mean, 6) AS mean, k, round(mean - half, 6) AS between_lo, round(mean + half, 6) AS between_hi, round(lo, 6) AS boot_lo, round(hi, 6) AS boot_hi, round(least(mean - half, lo), 6) AS ci_lo, round(greatest(mean + half, hi), 6) AS ci_hi, CASE WHEN hi - lo > 2 * half THEN 'bootstrap' ELSE 'between_set' END AS dominant_source FROM b""")
def distributional_summary(t):
    p = lambda q: F.percentile("o_totalprice", F.lit(q)) / 1000
    sets = t.orders.groupBy(F.col("o_orderpriority").alias("model_id"), F.lit(30.0).alias("duration_s"), (F.col("o_custkey") % 5).alias("set_idx")).agg(
        (F.avg("o_totalprice") / 1000).alias("fad"), F.struct(p(0.4).alias("ci_lo"), p(0.6).alias("ci_hi")).alias("fad_boot"),
        (F.avg("o_custkey") / 100).alias("kad"), F.struct((F.min("o_custkey") / 100).alias("ci_lo"), (F.max("o_custkey") / 100).alias("ci_hi")).alias("kad_boot"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return S.distributional_summary(sets).select("model_id", "metric", r("mean", "mean"), "k", r("between_lo", "between_lo"), r("between_hi", "between_hi"), r("boot_lo", "boot_lo"), r("boot_hi", "boot_hi"), r("combined.ci_lo", "ci_lo"), r("combined.ci_hi", "ci_hi"), "combined.dominant_source")


# -- the control of runs


def _plan(t):
    return t.lineitem.select(F.col("l_returnflag").alias("model_id"), F.col("l_linenumber").cast("double").alias("duration_s"), F.col("l_suppkey").alias("set_idx"), F.col("l_partkey").alias("track_idx"), F.col("l_orderkey").alias("k"), F.when(F.col("l_quantity") > 49, "not_applicable").otherwise("done").alias("status"))


@query("SELECT l_returnflag AS model_id, CAST(l_linenumber AS DOUBLE) AS duration_s, l_suppkey AS set_idx, l_partkey AS track_idx, l_orderkey AS k FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber IN (1, 3) AND l_suppkey IN (1, 2, 3, 5) AND l_partkey < 1000")
def scoped_plan(t):
    return runs.scoped(_plan(t).drop("status"), ["A", "R"], [1.0, 3.0], [1, 2, 3, 5], 1000)


@query("""WITH p AS (SELECT l_returnflag AS model_id, CAST(l_linenumber AS DOUBLE) AS duration_s, l_suppkey AS set_idx, l_partkey AS track_idx, l_orderkey AS k, CASE WHEN l_quantity > 49 THEN 'not_applicable' ELSE 'done' END AS status FROM lineitem),
f AS (SELECT model_id, duration_s, min(struct_pack(a := k, b := track_idx, c := set_idx)) AS f FROM p WHERE status = 'not_applicable' GROUP BY ALL)
SELECT p.* FROM p LEFT JOIN f USING (model_id, duration_s) WHERE f.f IS NULL OR struct_pack(a := k, b := track_idx, c := set_idx) <= f.f""")
def cells_cut_at_failure(t):
    return runs.cut_at_failure(_plan(t), ["k", "track_idx", "set_idx"])


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN c.c_custkey IS NOT NULL AND c_acctbal > 0 THEN c_acctbal ELSE o_totalprice END AS o_totalprice, CASE WHEN c.c_custkey IS NOT NULL THEN c_mktsegment END AS segment FROM (SELECT * FROM orders) o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON o.o_orderkey = c.c_custkey")
def merge_new_fields(t):
    new = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_orderkey"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("o_totalprice"), F.col("c_mktsegment").alias("segment"))
    return runs.merged_fields(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), new, ["o_orderkey"], ["o_totalprice", "segment"])


@query("SELECT DISTINCT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality IS NOT NULL)")
def recompute_without_score(t):
    """A record that lacks the score that is asked for is not done."""
    have = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return have.select("doc_id").distinct().join(runs.done_for(have, ["doc_id"], ["quality"]), "doc_id", "left_anti")


@query("SELECT o_orderkey, o_custkey, EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_acctbal > 0) AS there FROM orders o")
def missing_files(t):
    files = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("path"))
    there, missing = runs.split_missing(t.orders.select("o_orderkey", "o_custkey"), files, "o_custkey")
    return there.withColumn("there", F.lit(True)).unionByName(missing.withColumn("there", F.lit(False))).select("o_orderkey", "o_custkey", "there")


_FILES = "SELECT 'audio/' || p_brand || CASE WHEN p_size % 7 = 0 THEN '/convert/' ELSE '/' END || p_partkey || CASE WHEN p_size % 3 = 0 THEN '.npy' WHEN p_size % 3 = 1 THEN '.WAV' ELSE '.flac' END AS path, p_brand AS cell FROM part"


@query(f"SELECT path, cell FROM (SELECT *, row_number() OVER (PARTITION BY cell, NOT ends_with(path, '.npy') ORDER BY path) AS r FROM ({_FILES}) WHERE NOT contains(path, '/convert/')) WHERE ends_with(path, '.npy') OR r <= 2")
def archive_selection(t):
    tail = F.when(F.col("p_size") % 3 == 0, ".npy").when(F.col("p_size") % 3 == 1, ".WAV").otherwise(".flac")
    path = F.concat(F.lit("audio/"), "p_brand", F.when(F.col("p_size") % 7 == 0, "/convert/").otherwise("/"), "p_partkey", tail)
    return runs.archived(t.part.select(path.alias("path"), F.col("p_brand").alias("cell")), ["cell"])


@query("SELECT line, row_number() OVER (ORDER BY min(struct_pack(a := part, b := k)), line) AS place FROM (SELECT l_returnflag AS part, l_orderkey AS k, l_shipdate::DATE || '|' || l_linenumber AS line FROM lineitem) GROUP BY line ORDER BY min(struct_pack(a := part, b := k)), line LIMIT 200")
def merged_log_head(t):
    """The first 200 lines of a log merged from parts, each line where it first stood."""
    parts = t.lineitem.select(F.col("l_returnflag").alias("part"), F.col("l_orderkey").alias("k"), F.concat_ws("|", F.to_date("l_shipdate").cast("string"), "l_linenumber").alias("line"))
    from pyspark.sql import Window

    head = runs.merged_lines(parts, ["part", "k"]).orderBy("place", "line").limit(200)
    return head.select("line", F.row_number().over(Window.orderBy("place", "line")).alias("place"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'bfloat16' WHEN p_size % 3 = 1 AND p_size >= 25 THEN 'float16' ELSE 'float32' END AS resolved FROM part")
def capability_check(t):
    kind = F.when(F.col("p_size") % 3 == 0, "bfloat16").when(F.col("p_size") % 3 == 1, "float16").otherwise("float32")
    has = F.when(F.col("p_size") % 3 == 0, 8.6).when(F.col("p_size") >= 25, 7.5)
    return runs.checked_kinds(t.part.select("p_partkey", kind.alias("kind"), has.alias("has")), "kind", "has").select("p_partkey", "resolved")


@query("SELECT n_nationkey, 'node' AS host, '4' AS spark FROM nation")
def environment_lineage(t):
    return runs.with_fingerprint(t.nation.select("n_nationkey"), {"host": "node", "spark": "4"}).select("n_nationkey", "env.host", "env.spark")


@query("SELECT vec_id, name, round(CASE name WHEN 'q4' THEN round(x * 8, 0) / 8 WHEN 'q8' THEN round(x * 128, 0) / 128 ELSE x END, 6) AS x FROM (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings), (VALUES ('identity'), ('q4'), ('q8')) n(name)")
def codec_registry(t):
    """Every registered round trip over the same vectors."""
    x = F.col("embedding").cast("array<double>")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), runs.CODECS[n](x).alias("y")) for n in sorted(runs.CODECS.known)]))
    return t.embeddings.select("vec_id", each.alias("e")).select("vec_id", "e.name", F.round(F.element_at("e.y", 1), 6).alias("x"))


@query("SELECT vec_id, round(list_sum(x) / len(x), 6) AS mean, round(list_max(x), 6) AS hi, round(list_min(x), 6) AS lo FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)")
def embedder_lookup(t):
    v = runs.EMBEDDERS["moments"](F.col("embedding").cast("array<double>"))
    return t.embeddings.select("vec_id", v.alias("v")).select("vec_id", *[F.round(F.get("v", F.lit(i)), 6).alias(n) for i, n in enumerate(("mean", "hi", "lo"))])


@query("SELECT d.doc_id, coalesce(l.quality, length(d.text) % 7) AS score, l.doc_id IS NULL AS computed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def embedding_cache_or_compute(t):
    """What a cache holds, and the rest computed; a key that neither resolves fails the query."""
    cache = t.labels.select("doc_id", F.col("quality").cast("long").alias("score"))
    made = lambda rows: rows.select("doc_id", (F.length("text") % 7).cast("long").alias("score"))
    return runs.cached_or_computed(t.documents.select("doc_id", "text"), cache, "doc_id", "score", made)
