"""Queries of the statistics, of distances between embedding sets, and of the decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nan, stats
from ..functions.hashing import md5_mod
from ..operators import bootstrap as B
from ..operators import distances as D
from .catalog import query
from .relational_queries import _mod

Z = stats.z_quantile()
T = ", ".join(f"{stats.t_quantile(d)!r}::DOUBLE" for d in range(1, stats.T_DEGREES + 1))


def wilson_sql(k, n):
    z = f"{Z!r}::DOUBLE"
    mid, half = f"(({k} / {n}) + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n})", f"{z} * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + {z} * {z} / (4 * {n} * {n})) / (1 + {z} * {z} / {n})"
    return f"round({k} / {n}, 6) AS p, round({mid} - {half}, 6) AS ci_lo, round({mid} + {half}, 6) AS ci_hi, CAST({n} AS BIGINT) AS n"


def opened(df, name):
    return df.select(*[c for c in df.columns if c != name], *[F.round(f"{name}.{f.name}", 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"{name}.{f.name}").alias(f.name) for f in df.schema[name].dataType])


@query(f"SELECT o_orderpriority, {wilson_sql('k', 'n')} FROM (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS k, count(*)::DOUBLE AS n FROM orders GROUP BY 1)")
def wilson_ci(t):
    return opened(t.orders.groupBy("o_orderpriority").agg(stats.wilson(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("w")), "w")


_BETWEEN = f"""WITH s AS (SELECT event_type, user_id % 5 AS set_idx, avg(value) AS v FROM events GROUP BY ALL),
b AS (SELECT event_type, avg(v) AS mean, coalesce(stddev_samp(v) / sqrt(count(v)), 0) AS se, count(v) AS k FROM s GROUP BY 1),
bs AS (SELECT *, CASE WHEN k > 1 THEN [{T}][k - 1] * se ELSE 0 END AS half FROM b)"""


def set_values(t):
    return t.events.groupBy("event_type", (F.col("user_id") % 5).alias("set_idx")).agg(F.avg("value").alias("v"))


@query(_BETWEEN + " SELECT event_type, round(mean, 6) AS mean, round(se, 6) AS se, round(mean - half, 6) AS ci_lo, round(mean + half, 6) AS ci_hi, k FROM bs")
def between_set_ci(t):
    return opened(set_values(t).groupBy("event_type").agg(stats.between_set(F.col("v")).alias("b")), "b")


RESAMPLES = 200


def bootstrap_rows(values, group, resamples, seed=0):
    """(group, b, m): the means of resamples of (group, v_order, v)."""
    return B.resampled(values, [group], ["v_order"], {"m": B.weighted_mean(F.col("v"), F.col("w"))}, resamples, seed)


def boot_sql(values, group, resamples=RESAMPLES, seed=0, name="boot"):
    return f"""{name} AS (SELECT {group}, b, sum(v * w) / sum(w) AS m FROM ({B.weights_sql(values, group, 'v_order', resamples, seed)}) GROUP BY ALL)"""


_VALUES = "SELECT event_type, user_id AS v_order, avg(value) AS v FROM events GROUP BY event_type, user_id"


def cell_values(t):
    return t.events.groupBy("event_type", F.col("user_id").alias("v_order")).agg(F.avg("value").alias("v"))


def boot_ci(boot, group):
    p = lambda q: F.percentile("m", F.lit(q))
    return boot.groupBy(group).agg(p(0.025).alias("ci_lo"), p(0.975).alias("ci_hi"), F.stddev_pop("m").alias("boot_std"), F.count("*").alias("n_resamples"))


@query(f"WITH {boot_sql(_VALUES, 'event_type')}, pt AS (SELECT event_type, avg(v) AS point, count(*) AS n_observations FROM ({_VALUES}) GROUP BY 1) SELECT event_type, round(any_value(point), 6) AS point, round(quantile_cont(m, 0.025::DOUBLE), 6) AS ci_lo, round(quantile_cont(m, 0.975::DOUBLE), 6) AS ci_hi, round(stddev_pop(m), 6) AS boot_std, count(*) AS n_resamples, any_value(n_observations) AS n_observations FROM boot JOIN pt USING (event_type) GROUP BY 1")
def bootstrap_mean_ci(t):
    v = cell_values(t)
    point = v.groupBy("event_type").agg(F.avg("v").alias("point"), F.count("*").alias("n_observations"))
    out = boot_ci(bootstrap_rows(v, "event_type", RESAMPLES), "event_type").join(point, "event_type")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("point", "ci_lo", "ci_hi", "boot_std")], "n_resamples", "n_observations")


@query(f"WITH {boot_sql(_VALUES, 'event_type')} SELECT 'click' AS a, 'view' AS b, round(avg(x.m - y.m), 6) AS mean, round(quantile_cont(x.m - y.m, 0.025::DOUBLE), 6) AS ci_lo, round(quantile_cont(x.m - y.m, 0.975::DOUBLE), 6) AS ci_hi, quantile_cont(x.m - y.m, 0.025::DOUBLE) > 0 OR quantile_cont(x.m - y.m, 0.975::DOUBLE) < 0 AS significant FROM boot x JOIN boot y ON x.b = y.b AND x.event_type = 'click' AND y.event_type = 'view'")
def bootstrap_diff_ci(t):
    boot = bootstrap_rows(cell_values(t), "event_type", RESAMPLES)
    x, y = (boot.where(F.col("event_type") == k).select("b", F.col("m").alias(k)) for k in ("click", "view"))
    d = F.col("click") - F.col("view")
    lo, hi = F.percentile(d, F.lit(0.025)), F.percentile(d, F.lit(0.975))
    return x.join(y, "b").agg(F.lit("click").alias("a"), F.lit("view").alias("b"), F.round(F.avg(d), 6).alias("mean"), F.round(lo, 6).alias("ci_lo"), F.round(hi, 6).alias("ci_hi"), ((lo > 0) | (hi < 0)).alias("significant"))


@query(f"{_BETWEEN}, {boot_sql(_VALUES, 'event_type')}, c AS (SELECT event_type, quantile_cont(m, 0.025::DOUBLE) AS lo, quantile_cont(m, 0.975::DOUBLE) AS hi FROM boot GROUP BY 1) SELECT event_type, round(least(mean - half, lo), 6) AS ci_lo, round(greatest(mean + half, hi), 6) AS ci_hi, CASE WHEN hi - lo > 2 * half THEN 'bootstrap' ELSE 'between_set' END AS dominant_source FROM bs JOIN c USING (event_type)")
def combined_ci(t):
    between = set_values(t).groupBy("event_type").agg(stats.between_set(F.col("v")).alias("w"))
    boot = boot_ci(bootstrap_rows(cell_values(t), "event_type", RESAMPLES), "event_type")
    both = between.join(boot, "event_type").select("event_type", stats.combined(F.col("w.ci_lo"), F.col("w.ci_hi"), F.col("ci_lo"), F.col("ci_hi")).alias("c"))
    return opened(both, "c")


@query(f"WITH {boot_sql(_VALUES, 'event_type', seed=5)} SELECT event_type, printf('%.3f [%.3f, %.3f]', any_value(p), quantile_cont(m, 0.025::DOUBLE), quantile_cont(m, 0.975::DOUBLE)) AS cell FROM boot JOIN (SELECT event_type, avg(v) AS p FROM ({_VALUES}) GROUP BY 1) USING (event_type) GROUP BY 1")
def mean_with_ci(t):
    v = cell_values(t).where(nan.finite(F.col("v")))
    ci = boot_ci(bootstrap_rows(v, "event_type", RESAMPLES, seed=5), "event_type").join(v.groupBy("event_type").agg(F.avg("v").alias("p")), "event_type")
    return ci.select("event_type", stats.fmt(F.col("p"), F.col("ci_lo"), F.col("ci_hi")).alias("cell"))


# -- embeddings: file = vec_id mod 16; labels 0-4 are the reference, 5-9 are evaluated


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 16).alias("file"), F.col("label"), F.col("embedding").cast("array<double>").alias("x"))


V = "v AS (SELECT vec_id AS id, vec_id % 16 AS file, label, embedding::DOUBLE[] AS x FROM embeddings)"
D2 = "greatest(0, list_sum([pow(a.x[j] - b.x[j], 2) for j in range(1, 65)]))"


@query(f"WITH {V} SELECT a.id AS id, round(list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))), 6) AS cos FROM v a JOIN v b ON a.id + 1 = b.id")
def cosine_similarity(t):
    from ..operators.signals import cosine

    a = vectors(t).select("id", "x")
    b = a.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))
    return a.join(b, "id").select("id", F.round(cosine(F.col("x"), F.col("y")), 6).alias("cos"))


@query(f"WITH {V} SELECT a.id AS a, b.id AS b, round({D2}, 6) AS d2 FROM v a, v b WHERE a.id < b.id")
def pairwise_sq_dist(t):
    rows = vectors(t)
    return D.squared_distances(rows).select("a", "b", F.round("d2", 6).alias("d2"))


@query(f"WITH {V}, r AS (SELECT * FROM v WHERE label < 5) SELECT round(sqrt(median({D2})), 6) AS bandwidth FROM r a, r b WHERE a.id < b.id")
def median_bandwidth(t):
    rows = vectors(t).where("label < 5")
    return D.median_bandwidth(rows).select(F.round("bandwidth", 6).alias("bandwidth"))


BW = 1.4
K = f"exp(-{D2} / (2 * {BW} * {BW}))"


@query(f"WITH {V} SELECT CAST(label AS INTEGER) AS label, round(avg(k), 6) AS k FROM (SELECT a.label, {K} AS k FROM v a, v b WHERE a.label = b.label AND a.id <> b.id) GROUP BY 1")
def kernel_mean(t):
    rows = vectors(t).withColumn("file", F.col("label").cast("long"))
    sums = D.kernel_sums(rows, None, BW, by=["label"]).where("fa = fb")
    n = rows.groupBy("file").agg(F.count("*").alias("n"))
    return sums.join(n, F.col("fa") == F.col("file")).select(F.col("fa").cast("int").alias("label"), F.round((F.col("s") - F.col("trace")) / (F.col("n") * (F.col("n") - 1)), 6).alias("k"))


@query(f"WITH {V} SELECT a.file AS fa, b.file AS fb, round(avg({K}), 6) AS k FROM v a, v b WHERE a.label < 5 AND b.label >= 5 GROUP BY ALL")
def kernel_cross_mean(t):
    rows = vectors(t)
    r, e = rows.where("label < 5"), rows.where("label >= 5")
    sums = D.kernel_sums(r, e, BW)
    nr, ne = (x.groupBy(F.col("file").alias(k)).agg(F.count("*").alias(f"n_{k}")) for x, k in ((r, "fa"), (e, "fb")))
    return sums.join(nr, "fa").join(ne, "fb").select("fa", "fb", F.round(F.col("s") / (F.col("n_fa") * F.col("n_fb")), 6).alias("k"))


def kad_rows(rows_r, rows_e):
    """One row: s_rr, t_rr, n_r, s_ee, t_ee, n_e, s_re of two sets."""
    rows_r, rows_e = (x.withColumn("file", F.lit(0)) for x in (rows_r, rows_e))
    one = lambda a, b, names: D.kernel_sums(a, b, BW).agg(F.sum("s").alias(names[0]), F.sum("trace").alias(names[1]))
    parts = [one(rows_r, None, ("s_rr", "t_rr")), one(rows_e, None, ("s_ee", "t_ee")), one(rows_r, rows_e, ("s_re", "t_re")),
             rows_r.agg(F.count("*").alias("n_r")), rows_e.agg(F.count("*").alias("n_e"))]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.crossJoin(p)
    return out


def kad_value():
    return D.kad_from_sums(*[F.col(c) for c in ("s_rr", "t_rr", "n_r", "s_ee", "t_ee", "n_e", "s_re")])


def kad_sql(r, e):
    return f"""k_rr AS (SELECT avg({K}) AS k FROM ({r}) a, ({r}) b WHERE a.id <> b.id), k_ee AS (SELECT avg({K}) AS k FROM ({e}) a, ({e}) b WHERE a.id <> b.id), k_re AS (SELECT avg({K}) AS k FROM ({r}) a, ({e}) b)
SELECT round(k_rr.k + k_ee.k - 2 * k_re.k, 6) AS kad FROM k_rr, k_ee, k_re"""


@query(f"WITH {V}, {kad_sql('SELECT * FROM v WHERE label < 5', 'SELECT * FROM v WHERE label >= 5')}")
def kad_mmd(t):
    rows = vectors(t)
    return kad_rows(rows.where("label < 5"), rows.where("label >= 5")).select(F.round(kad_value(), 6).alias("kad"))


_HALF = _mod("CAST(file AS VARCHAR)", 2)


@query(f"WITH {V}, {kad_sql(f'SELECT * FROM v WHERE {_HALF} = 0', f'SELECT * FROM v WHERE {_HALF} = 1')}")
def split_half_floor(t):
    rows = vectors(t).withColumn("half", md5_mod(F.col("file").cast("string"), 2))
    return kad_rows(rows.where("half = 0"), rows.where("half = 1")).select(F.round(kad_value(), 6).alias("kad"))


@query(f"WITH {V}, q AS (SELECT id + 1000000 AS id, file, label, [round(z * 8, 0) / 8 for z in x] AS x FROM v), {kad_sql('SELECT * FROM v', 'SELECT * FROM q')}")
def roundtrip_floor(t):
    """The distance that a lossy transform alone brings about: vectors against their quantised selves."""
    rows = vectors(t)
    coarse = rows.withColumn("id", F.col("id") + 1000000).withColumn("x", F.transform("x", lambda z: F.round(z * 8, 0) / 8))
    return kad_rows(rows, coarse).select(F.round(kad_value(), 6).alias("kad"))


RESAMPLED_FILES = 100
_LABELS = "CASE WHEN label < 5 THEN 'r' ELSE 'e' END"


def _cluster_sql(bandwidth):
    k = f"exp(-{D2} / (2 * {bandwidth} * {bandwidth}))"
    weights = B.weights_sql("SELECT file, count(*) AS n FROM e GROUP BY file", "file", "''", RESAMPLED_FILES).replace("|| '|' || '' ||", "||")
    return f"""see AS (SELECT a.file AS fa, b.file AS fb, sum({k}) AS s, sum(CASE WHEN a.id = b.id THEN 1.0::DOUBLE ELSE 0 END) AS tr FROM e a, e b GROUP BY ALL),
sre AS (SELECT b.file AS f, sum({k}) AS s FROM r a, e b GROUP BY ALL),
rr AS (SELECT avg({k}) AS k FROM r a, r b WHERE a.id <> b.id), nr AS (SELECT count(*)::DOUBLE AS n FROM r),
w AS ({weights} UNION ALL SELECT file, count(*) AS n, -1 AS b, '' AS h, 1 AS w FROM e GROUP BY file),
nn AS (SELECT b, sum(w * n)::DOUBLE AS n FROM w GROUP BY b),
ee AS (SELECT x.b, sum(x.w * y.w * s) AS s FROM w x JOIN w y ON x.b = y.b JOIN see ON fa = x.file AND fb = y.file GROUP BY x.b),
tt AS (SELECT b, sum(w * tr) AS t FROM w JOIN see ON fa = file AND fb = file GROUP BY b),
re AS (SELECT b, sum(w * s) AS s FROM w JOIN sre ON f = file GROUP BY b),
k AS (SELECT b, rr.k + (ee.s - tt.t) / (nn.n * (nn.n - 1)) - 2 * re.s / (nn.n * nr.n) AS kad FROM nn JOIN ee USING (b) JOIN tt USING (b) JOIN re USING (b), rr, nr)
SELECT count(*) FILTER (b >= 0) AS n_resamples, round(max(kad) FILTER (b < 0), 6) AS point, round(quantile_cont(kad, 0.025::DOUBLE) FILTER (b >= 0), 6) AS ci_lo, round(quantile_cont(kad, 0.975::DOUBLE) FILTER (b >= 0), 6) AS ci_hi, round(stddev_pop(kad) FILTER (b >= 0), 6) AS boot_std FROM k"""


def _told(k):
    drawn = F.when(F.col("b") >= 0, F.col("kad"))
    p = lambda q: F.round(F.percentile(drawn, F.lit(q)), 6)
    return k.agg(F.count(drawn).alias("n_resamples"), F.round(F.max(F.when(F.col("b") < 0, F.col("kad"))), 6).alias("point"), p(0.025).alias("ci_lo"), p(0.975).alias("ci_hi"), F.round(F.stddev_pop(drawn), 6).alias("boot_std"))


@query(f"WITH {V}, e AS (SELECT * FROM v WHERE label >= 5), r AS (SELECT * FROM v WHERE label < 5), {_cluster_sql(BW)}")
def cluster_bootstrap_kad(t):
    """KAD of resampled files, from per-file kernel sums: one pass over the vectors, whatever the number of resamples."""
    rows = vectors(t)
    ref = D.ReferenceContext(rows.where("label < 5"), 64, bandwidth=BW)
    return _told(D.kad_resamples(ref, rows.where("label >= 5"), RESAMPLED_FILES))


_SAMPLED = "SELECT * FROM v WHERE label < 5 ORDER BY md5('0|' || id), id LIMIT 150"
_BAND = f"(SELECT sqrt(median({D2})) FROM (SELECT * FROM r ORDER BY md5('0|' || id), id LIMIT 100) a, (SELECT * FROM r ORDER BY md5('0|' || id), id LIMIT 100) b WHERE a.id < b.id)"


@query(f"WITH {V}, e AS (SELECT * FROM v WHERE label >= 5), r AS ({_SAMPLED}), bw AS (SELECT {_BAND} AS x), {_cluster_sql('(SELECT x FROM bw)')}")
def reference_context_kad(t):
    """KAD against a sampled reference, its bandwidth by the median rule over a smaller sample of that."""
    rows = vectors(t)
    ref = D.ReferenceContext(rows.where("label < 5"), 64, most=150)
    ref.bandwidth = D.median_bandwidth(ref.sample, most=100)
    own = D.kernel_sums(ref.sample.withColumn("file", F.lit(0)), None, ref.bandwidth).agg(F.sum("s").alias("s_rr"), F.sum("trace").alias("t_rr"))
    ref.own = own.crossJoin(ref.sample.agg(F.count("*").cast("double").alias("n_r")))
    return _told(D.kad_resamples(ref, rows.where("label >= 5"), RESAMPLED_FILES))


@query()
def evaluate_set(t):
    """FAD and KAD of the evaluated set with intervals over its files; tests hold both against NumPy."""
    rows = vectors(t)
    got = D.evaluate_set(D.ReferenceContext(rows.where("label < 5"), 64), rows.where("label >= 5"), 50)
    return got.select("metric", *[F.round(c, 6).alias(c) for c in ("point", "ci_lo", "ci_hi", "boot_std")], "n_resamples")


@query(f"WITH w AS ({B.weights_sql(_VALUES, 'event_type', 'v_order', 100, 3)}), m AS (SELECT event_type, b, median(v) AS m FROM (SELECT event_type, b, v, unnest(range(w)) FROM w) GROUP BY ALL), p AS (SELECT event_type, median(v) AS p, count(*) AS n FROM ({_VALUES}) GROUP BY 1) SELECT event_type, round(any_value(p), 6) AS point, round(quantile_cont(m, 0.025::DOUBLE), 6) AS ci_lo, round(quantile_cont(m, 0.975::DOUBLE), 6) AS ci_hi, round(stddev_pop(m), 6) AS boot_std, count(*) AS n_resamples, any_value(n) AS n_observations FROM m JOIN p USING (event_type) GROUP BY 1")
def bootstrap_any_statistic(t):
    """The bootstrap of a statistic of one's own, here the median."""
    got = B.bootstrap_ci(cell_values(t), ["event_type"], ["v_order"], statistic=B.weighted_percentile(0.5), resamples=100, seed=3)
    return got.select("event_type", *[F.round(c, 6).alias(c) for c in ("point", "ci_lo", "ci_hi", "boot_std")], "n_resamples", "n_observations")


@query(f"WITH {V}, l AS (SELECT id, j, x[j] AS z FROM v, range(1, 65) r(j)) SELECT a.j - 1 AS i, b.j - 1 AS j, round(avg(a.z), 6) AS mean_i, round(covar_samp(a.z, b.z), 8) AS cov FROM l a JOIN l b ON a.id = b.id AND a.j <= b.j GROUP BY ALL")
def vector_gauss_stats(t):
    g = D.gauss_stats(vectors(t), 64)
    cells = g.select("mu", F.posexplode("sigma").alias("p", "cov")).select((F.col("p") / 64).cast("long").alias("i"), (F.col("p") % 64).cast("long").alias("j"), "mu", "cov").where("i <= j")
    return cells.select("i", "j", F.round(F.get("mu", F.col("i").cast("int")), 6).alias("mean_i"), F.round("cov", 8).alias("cov"))


@query(f"WITH {V}, l AS (SELECT label < 5 AS ref, j, x[j] AS z FROM v, range(1, 65) r(j)), s AS (SELECT ref, j, avg(z) AS m, var_samp(z) AS s FROM l GROUP BY ALL) SELECT round(sum(pow(a.m - b.m, 2) + a.s + b.s - 2 * sqrt(a.s * b.s)), 6) AS fad FROM s a JOIN s b ON a.j = b.j AND a.ref AND NOT b.ref")
def frechet_diag(t):
    """The Fréchet distance of Gaussians without covariances."""
    long = vectors(t).select((F.col("label") < 5).alias("ref"), F.posexplode("x").alias("j", "z"))
    s = long.groupBy("j").agg(*[f(F.when(F.col("ref") == r, F.col("z"))).alias(n) for r, f, n in ((True, F.avg, "ma"), (True, F.var_samp, "sa"), (False, F.avg, "mb"), (False, F.var_samp, "sb"))])
    d = F.col("ma") - F.col("mb")
    return s.agg(F.round(F.sum(d * d + F.col("sa") + F.col("sb") - 2 * F.sqrt(F.col("sa") * F.col("sb"))), 6).alias("fad"))


@query()
def frechet_distance(t):
    rows = vectors(t)
    return D.frechet_distance(rows.where("label < 5"), rows.where("label >= 5"), 64).select(F.round("fad", 6).alias("fad"))


# -- the report as text


_CELLS = f"""c AS (SELECT l_returnflag AS model, l_linenumber AS duration, count(*)::DOUBLE AS n, count(*) FILTER (l_discount > 0.09)::DOUBLE AS deg,
  count(*) FILTER (l_quantity <= 27 AND l_discount <= 0.09)::DOUBLE AS seam, count(*) FILTER (l_tax <= 0.05 AND l_discount <= 0.09)::DOUBLE AS grid,
  count(*) FILTER (l_quantity <= 27 AND l_tax <= 0.05 AND l_discount <= 0.09)::DOUBLE AS pair, avg(l_extendedprice) AS score FROM lineitem GROUP BY ALL)"""


def cells(t):
    good = F.col("l_discount") <= 0.09
    seam, grid = good & (F.col("l_quantity") <= 27), good & (F.col("l_tax") <= 0.05)
    return t.lineitem.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("duration")).agg(
        F.count("*").alias("n"), stats.wilson(F.count_if(~good), F.count("*")).alias("deg"), stats.wilson(F.count_if(seam), F.count("*")).alias("seam"),
        stats.wilson(F.count_if(grid), F.count("*")).alias("grid"), stats.wilson(F.count_if(seam & grid), F.count("*")).alias("both"), F.avg("l_extendedprice").alias("score"))


def _w(k):
    z = f"{Z!r}::DOUBLE"
    return f"(({k} / n + {z} * {z} / (2 * n)) / (1 + {z} * {z} / n) - {z} * sqrt(({k} / n) * (1 - {k} / n) / n + {z} * {z} / (4 * n * n)) / (1 + {z} * {z} / n))"


def _hi(k):
    z = f"{Z!r}::DOUBLE"
    return f"(({k} / n + {z} * {z} / (2 * n)) / (1 + {z} * {z} / n) + {z} * sqrt(({k} / n) * (1 - {k} / n) / n + {z} * {z} / (4 * n * n)) / (1 + {z} * {z} / n))"


@query(f"WITH {_CELLS} SELECT duration, string_agg('| ' || model || ' | ' || printf('%.3f [%.3f, %.3f]', seam / n, {_w('seam')}, {_hi('seam')}) || ' |', chr(10) ORDER BY model) AS rows FROM c GROUP BY 1")
def summary_markdown_rows(t):
    line = F.concat(F.lit("| "), F.col("model"), F.lit(" | "), stats.fmt(F.col("seam.p"), F.col("seam.ci_lo"), F.col("seam.ci_hi")), F.lit(" |"))
    return cells(t).select("duration", F.struct("model", line.alias("line")).alias("r")).groupBy("duration").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("rows"))
