"""Queries of the signal kernels. A track is one user's event values in order of time."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import nan
from ..operators import signals as S
from .catalog import query

W, HOP, SR = 8, 4, 1000
BINS, NFFT = S.fft_size(W) // 2 + 1, S.fft_size(W)

TRACKS = "a AS (SELECT user_id AS id, list(value ORDER BY ts, event_id) AS y, count(*) AS n FROM events GROUP BY 1)"
R6 = "round({}, 6)".format


def tracks(t):
    return S.tracks(t.events, "user_id", ["ts", "event_id"], "value")


# -- the kernels in SQL


def sl(y, s, w):
    return f"{y}[({s}) + 1 : ({s}) + {w}]"


def spec(x, w=W):
    n = S.fft_size(w)
    win = f"(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (j - 1) / {w - 1}))"
    part = lambda f: f"list_sum([({x})[j] * {win} * {f}(2 * pi() * k * (j - 1) / {n}) for j in range(1, {w + 1})])"
    return f"[ln(1 + sqrt(pow({part('cos')}, 2) + pow({part('sin')}, 2))) for k in range({n // 2 + 1})]"


def nrm(a):
    return f"sqrt(list_sum([v * v for v in {a}]))"


def dist(a, b, m=BINS):
    return f"(sqrt(list_sum([pow(({a})[q] - ({b})[q], 2) for q in range(1, {m + 1})])) / ({nrm(a)} + {nrm(b)} + 1e-8::DOUBLE))"


def level(x):
    return f"sqrt(list_sum([v * v for v in {x}]) / len({x}) + 1e-12::DOUBLE)"


def rel(a, b):
    return f"(abs({a} - {b}) / ({a} + {b} + 1e-8::DOUBLE))"


def q(values, p):
    return f"list_aggregate({values}, 'quantile_cont', {p}::DOUBLE)"


def mean(a):
    return f"list_avg({a})"


DIFF = "[abs(y[j + 1] - y[j]) for j in range(1, CAST(n AS BIGINT))]"

TRANS = f"""{TRACKS},
draws AS (
  SELECT id, y, n, unnest(CASE WHEN n > {8 * W} THEN range(CAST(least(200, greatest(1, (n - {4 * W}) // {W})) AS BIGINT)) ELSE []::BIGINT[] END) AS b FROM a),
starts AS (SELECT id, y, {2 * W} + ('0x' || md5('0|' || id || '|' || b)[1:8])::BIGINT % (n - {6 * W}) AS s FROM draws),
pairs AS (
  SELECT id, {spec(sl('y', 's', W))} AS f1, {spec(sl('y', f's + {W}', W))} AS f2, {level(sl('y', 's', W))} AS r1, {level(sl('y', f's + {W}', W))} AS r2 FROM starts),
trans AS (SELECT id, list({dist('f1', 'f2')}) AS d, list({rel('r1', 'r2')}) AS r FROM pairs GROUP BY id)"""


# -- windows and differences


@query("SELECT event_type, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS tile, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tile_windows(t):
    tile = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000).cast("long")
    return t.events.groupBy("event_type", tile.alias("tile")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(f"WITH {TRACKS} SELECT id, s AS start, {R6(mean('y[s + 1 : s + 10]'))} AS m FROM (SELECT id, y, unnest(range(0, CAST(n - 10 AS BIGINT), 5)) AS s FROM a)")
def sliding_window_mean(t):
    rows = tracks(t).where(F.size("y") > 10)
    s = rows.select("id", "y", F.explode(F.sequence(F.lit(0), F.size("y") - 11, F.lit(5))).alias("s"))
    return s.select("id", F.col("s").cast("long").alias("start"), F.round(S.mean(S.at(F.col("y"), F.col("s"), 10)), 6).alias("m"))


@query("SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS d FROM events")
def first_difference(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("d"))


@query(f"WITH {TRACKS}, f AS (SELECT id, s, {spec(sl('y', 's', W))} AS f1, {spec(sl('y', f's + {W}', W))} AS f2 FROM (SELECT id, y, unnest(range(0, CAST(n - {2 * W} + 1 AS BIGINT), {W})) AS s FROM a WHERE n >= {2 * W})) SELECT id, s AS start, {R6(dist('f1', 'f2'))} AS d FROM f")
def adjacent_transition(t):
    rows = tracks(t).where(F.size("y") >= 2 * W)
    s = rows.select("id", "y", F.explode(F.sequence(F.lit(0), F.size("y") - 2 * W, F.lit(W))).alias("s"))
    f = s.select("id", "s", S.log_spectrum(S.at(F.col("y"), F.col("s"), W), W).alias("f1"), S.log_spectrum(S.at(F.col("y"), F.col("s") + W, W), W).alias("f2"))
    return f.select("id", F.col("s").cast("long").alias("start"), F.round(S.spectral_distance(F.col("f1"), F.col("f2")), 6).alias("d"))


_DB = f"[20 * log10(greatest(sqrt(list_avg([v * v for v in y[s + 1 : s + {W}]])), 1e-12)) for s in range(0, CAST(n - {W} + 1 AS BIGINT), {W // 2})]"


@query(f"WITH {TRACKS} SELECT id, len({_DB}) AS frames, {R6(f'list_avg({_DB})')} AS mean_db, {R6(q(_DB, 0.95) + ' - ' + q(_DB, 0.05))} AS dynamic_range_db FROM a WHERE n >= {W}")
def frame_rms_db(t):
    db = tracks(t).where(F.size("y") >= W).select("id", S.frame_rms_db(F.col("y"), W).alias("db"))
    return db.select("id", F.size("db").cast("long").alias("frames"), F.round(S.mean(F.col("db")), 6).alias("mean_db"), F.round(S.quantile(F.col("db"), 0.95) - S.quantile(F.col("db"), 0.05), 6).alias("dynamic_range_db"))


@query(f"WITH {TRACKS} SELECT id, round(CASE WHEN n < {W} THEN 1 ELSE len(list_filter({_DB}, lambda v: v < 20)) / len({_DB}) END, 6) AS silent_frac FROM a")
def silent_fraction(t):
    return tracks(t).select("id", F.round(S.silent_fraction(F.col("y"), W, below=20.0), 6).alias("silent_frac"))


@query(f"WITH {TRACKS}, p AS (SELECT id, y, list_max([abs(v) for v in y]) AS peak FROM a) SELECT id, round(list_sum(z), 6) AS total, round(list_max([abs(v) for v in z]), 6) AS peak FROM (SELECT id, CASE WHEN peak >= 1e-8 THEN [v * 0.9::DOUBLE / peak for v in y] ELSE y END AS z FROM p)")
def peak_normalize(t):
    z = tracks(t).select("id", S.peak_normalised(F.col("y")).alias("z"))
    return z.select("id", F.round(S.total(F.col("z")), 6).alias("total"), F.round(F.array_max(F.transform("z", lambda v: F.abs(v))), 6).alias("peak"))


# -- spectra


@query(f"WITH {TRACKS}, f AS (SELECT id, {spec(sl('y', 0, W))} AS f FROM a WHERE n >= {W}) SELECT id, bin, {R6('f[bin + 1]')} AS value FROM f, range({BINS}) r(bin)")
def dft_log_spectrum(t):
    f = tracks(t).where(F.size("y") >= W).select("id", S.log_spectrum(S.at(F.col("y"), 0, W), W).alias("f"))
    return f.select("id", F.posexplode("f").alias("bin", "value")).select("id", F.col("bin").cast("long").alias("bin"), F.round("value", 6).alias("value"))


@query(f"WITH {TRACKS}, f AS (SELECT id, {spec(sl('y', f'n - {W}', W))} AS f1, {spec(sl('y', 0, W))} AS f2 FROM a WHERE n >= {W}) SELECT id, {R6(dist('f1', 'f2'))} AS d FROM f")
def spectral_distance(t):
    y = F.col("y")
    f = tracks(t).where(F.size("y") >= W).select("id", S.log_spectrum(S.at(y, F.size(y) - W, W), W).alias("f1"), S.log_spectrum(S.at(y, 0, W), W).alias("f2"))
    return f.select("id", F.round(S.spectral_distance(F.col("f1"), F.col("f2")), 6).alias("d"))


@query(f"WITH {TRACKS} SELECT id, {R6(rel(level(sl('y', f'n - {W}', W)), level(sl('y', 0, W))))} AS jump FROM a WHERE n >= {W}")
def rms_jump(t):
    y = F.col("y")
    return tracks(t).where(F.size("y") >= W).select("id", F.round(S.jump(S.rms(S.at(y, F.size(y) - W, W)), S.rms(S.at(y, 0, W))), 6).alias("jump"))


_CLICK = f"(list_max([abs(y[2] - y[1]), abs(y[1] - y[n])]) / ({q(DIFF, 0.99)} + 1e-8::DOUBLE))"


@query(f"WITH {TRACKS} SELECT id, {R6(_CLICK)} AS click FROM a WHERE n >= {4 * W}")
def click_ratio(t):
    y, n = F.col("y"), F.size("y")
    joined = S.differences(F.concat(S.at(y, n - 1, 1), S.at(y, 0, 2)))
    return tracks(t).where(n >= 4 * W).select("id", F.round(F.array_max(joined) / (S.quantile(S.differences(y), 0.99) + 1e-8), 6).alias("click"))


@query(f"WITH {TRANS} SELECT a.id, coalesce(len(d), 0) AS n, {R6(q('d', 0.5))} AS median, {R6(q('d', 0.95))} AS p95, {R6(q('r', 0.5))} AS rms_median, {R6(q('r', 0.95))} AS rms_p95 FROM a LEFT JOIN trans USING (id)")
def internal_transition_stats(t):
    rows = S.transitions(tracks(t), W)
    p = lambda c, v: F.round(S.quantile(F.col(c), v), 6)
    return rows.select("id", F.size("d").cast("long").alias("n"), p("d", 0.5).alias("median"), p("d", 0.95).alias("p95"), p("r", 0.5).alias("rms_median"), p("r", 0.95).alias("rms_p95"))


_SEAM = f"""WITH {TRANS},
seam AS (
  SELECT id, y, n, {dist('f1', 'f2')} AS seam, {rel(level(sl('y', f'n - {W}', W)), level(sl('y', 0, W)))} AS jump, {_CLICK} AS click
  FROM (SELECT id, y, n, {spec(sl('y', f'n - {W}', W))} AS f1, {spec(sl('y', 0, W))} AS f2 FROM a WHERE n >= {4 * W})),
s AS (SELECT seam.*, coalesce({q('d', 0.5)}, seam) AS med, coalesce({q('d', 0.95)}, seam) AS p95, {q('r', 0.5)} AS rmed, coalesce(len(d), 0) AS pairs FROM seam LEFT JOIN trans USING (id))
SELECT id, round(seam, 6) AS seam_spectral_dist, round(med, 6) AS internal_median, round(p95, 6) AS internal_p95, round(seam / (med + 1e-8), 6) AS seam_score, seam <= p95 AS seam_ok_p95,
  round(jump, 6) AS seam_rms_jump, round(coalesce(jump / (rmed + 1e-8), 'nan'::DOUBLE), 6) AS rms_score, round(click, 6) AS click_ratio, click <= 1 AS click_ok, CAST(pairs AS INTEGER) AS n_internal_pairs FROM s"""


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes])


@query(_SEAM)
def seam_report(t):
    return rounded(S.seam_report(tracks(t), W, SR))


_LOOP = f"""WITH {TRACKS},
base AS (
  SELECT id, y, n, CAST(floor(n * 0.5::DOUBLE) AS BIGINT) AS m, {spec(sl('y', 0, W))} AS s0, {spec(sl('y', f'n - {W}', W))} AS s1 FROM a WHERE n >= {4 * W}),
cand AS (
  SELECT id, n, 0 AS turn, 0 AS place, 0 AS cut, {dist('s1', 's0')} AS d FROM base
  UNION ALL SELECT id, n, 1, c, c, {dist('f', 's1')} FROM (SELECT id, n, s1, c, {spec(sl('y', 'c', W))} AS f FROM (SELECT *, unnest(range({HOP}, n - m - {W}, {HOP})) AS c FROM base))
  UNION ALL SELECT id, n, 2, -c, c, {dist('f', 's0')} FROM (SELECT id, n, s0, c, {spec(sl('y', f'c - {W}', W))} AS f FROM (SELECT *, unnest(range(n - {HOP}, greatest(m, {W}), -{HOP})) AS c FROM base))),
best AS (SELECT id, any_value(n) AS n, min(struct_pack(d := d, turn := turn, place := place, cut := cut)) AS b, min(d) FILTER (turn = 0) AS naive FROM cand GROUP BY id)
SELECT id, round(naive, 6) AS naive_seam_dist, ['naive', 'cut_start', 'cut_end'][b.turn + 1] AS best_variant, CAST(b.cut AS INTEGER) AS best_cut_sample,
  CAST(CASE WHEN b.turn = 1 THEN b.cut ELSE 0 END AS INTEGER) AS loop_start, CAST(CASE WHEN b.turn = 2 THEN b.cut ELSE n END AS INTEGER) AS loop_end,
  round(b.d, 6) AS best_seam_dist, round(naive - b.d, 6) AS improvement_over_naive FROM best"""


@query(_LOOP)
def best_loop(t):
    return rounded(S.best_loop(tracks(t), W, HOP))


_SPECTRA = f"[{spec(sl('y', 's', W))} for s in range(0, CAST(n - {W} + 1 AS BIGINT), {HOP})]"
_FLAT = "[exp(list_avg([ln(p) for p in pw])) / list_avg(pw) for pw in [[greatest(1e-10::DOUBLE, pow(exp(v) - 1, 2)) for v in f] for f in fs]]"
_FLUX = f"CASE WHEN len(fs) > 1 THEN list_avg([list_sum([greatest(us[g + 1][b] - us[g][b], 0) for b in range(1, {BINS + 1})]) for g in range(1, len(us))]) ELSE 0 END"
_FEATS = f"""{TRACKS},
sp AS (SELECT id, y, n, {_SPECTRA} AS fs FROM a WHERE n >= {W}),
un AS (SELECT *, [[v / ({nrm('f')} + 1e-8::DOUBLE) for v in f] for f in fs] AS us FROM sp),
feats AS (
  SELECT id, n, list_avg({_FLAT}) AS flat, {_FLUX} AS flux, len(list_filter({_DB}, lambda v: v < 20)) / len({_DB}) AS silent, 20 * log10(greatest(list_max([abs(v) for v in y]), 1e-12)) AS peak FROM un)"""


def features(t):
    y = F.col("y")
    rows = tracks(t).where(F.size("y") >= W).select("id", "y", F.transform(S.frames(y, W, HOP), lambda f: S.log_spectrum(f, W)).alias("fs"))
    return rows.select("id", S.mean(F.transform("fs", S.flatness)).alias("flat"), S.flux(F.col("fs")).alias("flux"),
                       S.silent_fraction(y, W, below=20.0).alias("silent"), nan.dbfs(F.array_max(F.transform(y, lambda v: F.abs(v)))).alias("peak"))


@query(f"WITH {_FEATS} SELECT id, round(flat, 6) AS flatness FROM feats")
def spectral_flatness(t):
    return features(t).select("id", F.round("flat", 6).alias("flatness"))


@query(f"WITH {_FEATS} SELECT id, round(flux, 6) AS flux FROM feats")
def spectral_flux(t):
    return features(t).select("id", F.round("flux", 6).alias("flux"))


LIMITS = {"peak_dbfs_min": 32.0, "silent_frac_max": 0.3, "spectral_flatness_max": 0.2, "spectral_flux_min": 0.45}
_REASONS = "list_filter([CASE WHEN peak < 32.0 THEN 'silent_output' END, CASE WHEN silent > 0.3 THEN 'mostly_silence' END, CASE WHEN flat > 0.2 THEN 'noise_like' END, CASE WHEN flux < 0.45 THEN 'static_signal' END], lambda x: x IS NOT NULL)"


def reasons():
    return S.degeneracy_reasons(F.col("peak"), F.col("silent"), F.col("flat"), F.col("flux"), LIMITS)


@query(f"WITH {_FEATS} SELECT id, array_to_string({_REASONS}, ',') AS reasons, len({_REASONS}) > 0 AS degenerate FROM feats")
def degeneracy_flags(t):
    return features(t).select("id", F.array_join(reasons(), ",").alias("reasons"), (F.size(reasons()) > 0).alias("degenerate"))


@query(f"WITH {_FEATS} SELECT id, round(silent, 6) AS silent_frac, round(flat, 6) AS spectral_flatness, round(flux, 6) AS spectral_flux, round(peak, 6) AS orig_peak_dbfs, len({_REASONS}) > 0 AS degenerate, array_to_string({_REASONS}, ',') AS reasons FROM feats")
def degeneracy_report(t):
    r = lambda c, name: F.round(c, 6).alias(name)
    return features(t).select("id", r("silent", "silent_frac"), r("flat", "spectral_flatness"), r("flux", "spectral_flux"), r("peak", "orig_peak_dbfs"), (F.size(reasons()) > 0).alias("degenerate"), F.array_join(reasons(), ",").alias("reasons"))


@query(f"WITH {_FEATS} SELECT count(*) AS n, round(quantile_cont(silent, 0.99::DOUBLE), 6) AS silent_frac_max, round(quantile_cont(flat, 0.99::DOUBLE), 6) AS spectral_flatness_max, round(quantile_cont(flux, 0.01::DOUBLE), 6) AS spectral_flux_min, -40.0::DOUBLE AS peak_dbfs_min FROM feats")
def calibrate_thresholds(t):
    return calibrated(features(t)).select("n", *[F.round(c, 6).alias(c) for c in ("silent_frac_max", "spectral_flatness_max", "spectral_flux_min", "peak_dbfs_min")])


def calibrated(feats):
    """One row of thresholds: extreme percentiles of the finite reference features, defaults where there are none."""
    p = lambda c, v: F.percentile(nan.finite_or_null(F.col(c)), F.lit(v))
    return feats.agg(F.count("*").alias("n"), F.coalesce(p("silent", 0.99), F.lit(S.DEFAULTS["silent_frac_max"])).alias("silent_frac_max"), F.coalesce(p("flat", 0.99), F.lit(S.DEFAULTS["spectral_flatness_max"])).alias("spectral_flatness_max"),
                     F.coalesce(p("flux", 0.01), F.lit(S.DEFAULTS["spectral_flux_min"])).alias("spectral_flux_min"), F.lit(S.DEFAULTS["peak_dbfs_min"]).alias("peak_dbfs_min"))


@query(f"WITH {_FEATS}, c AS (SELECT quantile_cont(silent, 0.99::DOUBLE) AS s, quantile_cont(flat, 0.99::DOUBLE) AS f, quantile_cont(flux, 0.01::DOUBLE) AS x FROM feats) SELECT count(*) AS n, round(avg(CAST(peak < -40 OR silent > s OR flat > f OR flux < x AS DOUBLE)), 6) AS flagged FROM feats, c")
def calibration_self_check(t):
    feats = features(t)
    lim = calibrated(feats).drop("n")
    flags = S.degeneracy_reasons(F.col("peak"), F.col("silent"), F.col("flat"), F.col("flux"), {k: F.col(k) for k in S.DEFAULTS})
    return feats.crossJoin(F.broadcast(lim)).agg(F.count("*").alias("n"), F.round(F.avg((F.size(flags) > 0).cast("double")), 6).alias("flagged"))


# -- structure: a "chroma" vector is the event values of a user summed by k mod 12

CHROMA = "ch AS (SELECT id, list(v ORDER BY pc) AS c FROM (SELECT user_id AS id, pc, coalesce(sum(value) FILTER (CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 = pc), 0) AS v FROM events, range(12) r(pc) GROUP BY ALL) GROUP BY id)"
PROFILES = "tp AS (SELECT * FROM (VALUES " + ", ".join(
    f"({2 * s + (kind == 'minor')}, '{S.NAMES[s]} {kind}', {s if kind == 'major' else (s + 3) % 12}, [{', '.join(f'{base[(j - s) % 12]}::DOUBLE' for j in range(12))}])"
    for s in range(12) for kind, base in (("major", S.MAJOR), ("minor", S.MINOR))) + ") v(o, key, sig, p))"


def chroma(t):
    pc = (F.get_json_object("props", "$.k").cast("long") % 12).cast("int")
    each = t.events.groupBy(F.col("user_id").alias("id")).agg(*[F.sum(F.when(pc == i, F.col("value")).otherwise(0.0)).alias(f"c{i}") for i in range(12)])
    return each.select("id", F.array(*[f"c{i}" for i in range(12)]).alias("c"))


def corr_sql(a, b, n=12):
    da, db = f"(({a})[j] - list_avg({a}))", f"(({b})[j] - list_avg({b}))"
    s = lambda x: f"list_sum([{x} for j in range(1, {n + 1})])"
    return f"({s(f'{da} * {db}')} / sqrt({s(f'{da} * {da}')} * {s(f'{db} * {db}')}))"


@query(f"WITH {CHROMA}, {PROFILES} SELECT id, key, round({corr_sql('c', 'p')}, 6) AS r FROM ch, tp")
def template_correlation(t):
    rows = chroma(t).select("id", "c", F.explode(S.key_profiles()).alias("t"))
    return rows.select("id", F.col("t.key").alias("key"), F.round(S.correlation(F.col("c"), F.col("t.p")), 6).alias("r"))


_KEYS = f"keys AS (SELECT id, min(struct_pack(s := -round({corr_sql('c', 'p')}, 9), o := o, key := key, sig := sig)) AS b FROM ch, tp GROUP BY id)"


@query(f"WITH {CHROMA}, {PROFILES}, {_KEYS} SELECT id, b.key AS key, round(-b.s, 6) AS score, b.sig AS sig FROM keys")
def key_estimate(t):
    k = chroma(t).select("id", S.key_of(F.col("c")).alias("k"))
    return k.select("id", F.col("k.key").alias("key"), F.round("k.score", 6).alias("score"), F.col("k.sig").alias("sig"))


_FC = f"""fr AS (
  SELECT user_id AS id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 4) AS BIGINT) AS f, CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 AS pc, value FROM events),
fc AS (SELECT id, f, list(v ORDER BY pc) AS c FROM (SELECT id, f, r.pc AS pc, coalesce(sum(value) FILTER (fr.pc = r.pc), 0) AS v FROM fr, range(12) r(pc) GROUP BY ALL) GROUP BY ALL),
tr AS (SELECT id, list(c ORDER BY f) AS fs, count(*) AS n FROM fc GROUP BY id)"""


def chroma_frames(t):
    """Per user, a 12-part vector for each four events in a row."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pc = (F.get_json_object("props", "$.k").cast("long") % 12).cast("int")
    rows = t.events.select(F.col("user_id").alias("id"), F.floor((F.row_number().over(w) - 1) / 4).alias("f"), pc.alias("pc"), "value")
    each = rows.groupBy("id", "f").agg(*[F.sum(F.when(F.col("pc") == i, F.col("value")).otherwise(0.0)).alias(f"c{i}") for i in range(12)])
    ordered = F.array_sort(F.collect_list(F.struct("f", F.array(*[f"c{i}" for i in range(12)]).alias("c"))))
    return each.groupBy("id").agg(F.transform(ordered, lambda s: s["c"]).alias("fs"))


_UNIT = "[[x / (sqrt(list_sum([y * y for y in v])) + 1e-8::DOUBLE) for x in v] for v in fs]"
_LAGS = f"""{_FC}, u AS (SELECT id, n, {_UNIT} AS us FROM tr),
lags AS (SELECT id, n, k, list_avg([list_sum([us[i][j] * us[i + k][j] for j in range(1, 13)]) for i in range(1, CAST(n - k + 1 AS BIGINT))]) AS p
  FROM (SELECT id, n, us, unnest(range(2, n // 2)) AS k FROM u WHERE n // 2 > 4))"""


@query(f"WITH {_LAGS} SELECT id, k AS lag, round(p, 6) AS profile FROM lags")
def lag_profile(t):
    rows = chroma_frames(t).where(F.floor(F.size("fs") / 2) > 4).select("id", S.unit_vectors(F.col("fs")).alias("us"))
    rows = rows.select("id", "us", F.explode(F.sequence(F.lit(2), F.floor(F.size("us") / 2).cast("int") - 1)).alias("k"))
    return rows.select("id", F.col("k").cast("long").alias("lag"), F.round(S.lag_profile(F.col("us"), F.col("k")), 6).alias("profile"))


@query(f"WITH {_LAGS}, b AS (SELECT id, max(p) / (avg(p) + 1e-8) AS ratio, min(struct_pack(s := -p, k := k)) AS m, count(*) AS c FROM lags GROUP BY id) SELECT tr.id, round(coalesce(ratio, 'nan'::DOUBLE), 6) AS regularity_ratio, coalesce(CAST(m.k AS INTEGER), -1) AS peak_lag, coalesce(CAST(c AS INTEGER), 0) AS n_lags FROM tr LEFT JOIN b USING (id)")
def structural_regularity(t):
    r = S.regularity(chroma_frames(t), "fs", 2)
    return r.select("id", F.round("ratio", 6).alias("regularity_ratio"), "peak_lag", "n_lags")


_VM = "[list_avg([fs[i][j] for i in range({lo}, {hi})]) for j in range(1, 13)]"


@query(f"""WITH {_FC}, {PROFILES},
vs AS (SELECT id, -1 AS s, {_VM.format(lo='1', hi='CAST(n + 1 AS BIGINT)')} AS c FROM tr WHERE n >= 8
  UNION ALL SELECT id, s, {_VM.format(lo='s + 1', hi='s + 5')} FROM (SELECT id, n, fs, unnest(range(0, CAST(n - 4 AS BIGINT), 2)) AS s FROM tr WHERE n >= 8)),
k AS (SELECT id, s, min(struct_pack(s := -round({corr_sql('c', 'p')}, 9), o := o, key := key, sig := sig)) AS b FROM vs, tp GROUP BY ALL)
SELECT g.id, g.b.key AS global_key, count(*) AS n_windows, round(avg(CAST(w.b.sig <> g.b.sig AS DOUBLE)), 6) AS drift FROM k g JOIN k w ON g.id = w.id AND g.s = -1 AND w.s >= 0 GROUP BY ALL""")
def key_drift(t):
    # sums of the first f frames, so that a window's mean is a difference of two of them
    add = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
    zero = F.array(*[F.lit(0.0)] * 12)
    rows = chroma_frames(t).where(F.size("fs") >= 8)
    rows = rows.withColumn("n", F.size("fs")).withColumn("sums", F.aggregate("fs", F.array(zero), lambda acc, v: F.concat(acc, F.array(add(F.element_at(acc, -1), v)))))
    between = lambda lo, hi: F.zip_with(F.get("sums", hi), F.get("sums", lo), lambda p, q: (p - q) / (hi - lo))
    rows = rows.withColumn("whole", between(F.lit(0), F.col("n"))).withColumn("g", S.key_of(F.col("whole")))
    rows = rows.select("id", "sums", "g", F.explode(F.sequence(F.lit(0), F.col("n") - 5, F.lit(2))).alias("s"))
    rows = rows.withColumn("c", between(F.col("s"), F.col("s") + 4)).select("id", F.col("g.key").alias("global_key"), F.col("g.sig").alias("sig"), S.key_of(F.col("c")).alias("w"))
    return rows.groupBy("id", "global_key").agg(F.count("*").alias("n_windows"), F.round(F.avg((F.col("w.sig") != F.col("sig")).cast("double")), 6).alias("drift"))


# -- beats: event times of a user in seconds


_BEATS = "b AS (SELECT user_id AS id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE AS i, (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS s FROM events)"


def beats(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(1e6)
    return t.events.select(F.col("user_id").alias("id"), "event_id", (F.row_number().over(w) - 1).cast("double").alias("i"), s.alias("s"))


@query(f"WITH {_BEATS} SELECT id, count(*) AS n, round(regr_slope(s, i), 4) AS period, round(regr_intercept(s, i), 3) AS first FROM b GROUP BY id")
def beat_regression(t):
    return beats(t).groupBy("id").agg(F.count("*").alias("n"), F.round(F.regr_slope("s", "i"), 4).alias("period"), F.round(F.regr_intercept("s", "i"), 3).alias("first"))


def grid(rows, lo, hi, per_bar=4):
    """Beats within [lo, hi) against a regular grid: errors of the loop in bars and beats; degenerate below four beats."""
    inside = rows.where((F.col("s") >= F.col(lo)) & (F.col("s") < F.col(hi)))
    inside = inside.withColumn("j", (F.row_number().over(Window.partitionBy("id").orderBy("i")) - 1).cast("double"))
    fit = inside.groupBy("id").agg(F.count("*").alias("n_beats"), F.regr_slope("s", "j").alias("period"), F.regr_intercept("s", "j").alias("first"), F.first(lo).alias("lo"), F.first(hi).alias("hi"))
    ok = (F.col("n_beats") >= 4) & (F.col("period") > 0)
    d, last = F.col("hi") - F.col("lo"), F.col("first") + F.col("period") * (F.col("n_beats") - 1)
    off = lambda r: F.when(ok, F.abs(r - F.rint(r))).otherwise(F.lit(nan.NAN))
    return fit.select("id", "n_beats", off(d / (per_bar * F.col("period"))).alias("bar_fraction_error"), off(d / F.col("period")).alias("beat_fraction_error"),
                      off((F.col("hi") - last + F.col("first") - F.col("lo")) / F.col("period")).alias("seam_gap_beat_error"), (~ok).alias("degenerate"))


_GRID = f"""{_BEATS},
i AS (SELECT id, s, (row_number() OVER (PARTITION BY id ORDER BY i) - 1)::DOUBLE AS j FROM b WHERE s >= 432000 AND s < 2160000),
f AS (SELECT id, count(*) AS n_beats, regr_slope(s, j) AS period, regr_intercept(s, j) AS first FROM i GROUP BY id),
r AS (SELECT id, n_beats, n_beats >= 4 AND period > 0 AS ok, 1728000.0::DOUBLE / (4 * period) AS bar, 1728000.0::DOUBLE / period AS beat, (2160000 - (first + period * (n_beats - 1)) + first - 432000) / period AS gap FROM f),
g AS (SELECT id, n_beats, CASE WHEN ok THEN abs(bar - round_even(bar, 0)) ELSE 'nan'::DOUBLE END AS bar_error, CASE WHEN ok THEN abs(beat - round_even(beat, 0)) ELSE 'nan'::DOUBLE END AS beat_error,
  CASE WHEN ok THEN abs(gap - round_even(gap, 0)) ELSE 'nan'::DOUBLE END AS gap_error, coalesce(NOT ok, true) AS degenerate FROM r)"""


@query(f"WITH {_GRID} SELECT id, n_beats, round(bar_error, 4) AS bar_fraction_error, round(beat_error, 4) AS beat_fraction_error, round(gap_error, 4) AS seam_gap_beat_error, degenerate FROM g")
def beat_grid(t):
    g = grid(beats(t).withColumn("lo", F.lit(432000.0)).withColumn("hi", F.lit(2160000.0)), "lo", "hi")
    return g.select("id", "n_beats", *[F.round(c, 4).alias(c) for c in ("bar_fraction_error", "beat_fraction_error", "seam_gap_beat_error")], F.coalesce("degenerate", F.lit(True)).alias("degenerate"))


@query(f"WITH {_GRID} SELECT id, NOT degenerate AND gap_error <= 0.1 AND bar_error <= 0.1 AS grid_pass FROM g")
def grid_pass(t):
    g = grid(beats(t).withColumn("lo", F.lit(432000.0)).withColumn("hi", F.lit(2160000.0)), "lo", "hi")
    return g.select("id", (~F.coalesce("degenerate", F.lit(True)) & nan.at_most(F.col("seam_gap_beat_error"), 0.1) & nan.at_most(F.col("bar_fraction_error"), 0.1)).alias("grid_pass"))


@query(f"WITH x AS ({_SEAM}) SELECT id, seam_ok_p95 AND click_ok AS seam_pass FROM x")
def seam_pass(t):
    s = S.seam_report(tracks(t), W, SR)
    return s.select("id", (F.col("seam_ok_p95") & F.col("click_ok")).alias("seam_pass"))
