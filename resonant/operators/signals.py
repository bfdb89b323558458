"""Signal kernels as column expressions over arrays of samples: one row is one track.

A track is bounded (two minutes of samples), the number of tracks is not, so a
kernel is a map over rows without any shuffle. Short windows are computed by
expressions; for audio-sized windows ``signal_udf`` has the same kernels in Arrow
batches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_index
from ..functions.nan import NAN


def tracks(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(id, y): the samples of each key in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_x"))))
    return rows.groupBy(F.col(key).alias("id")).agg(F.transform(ordered, lambda s: s["_x"].cast("double")).alias("y"))


def at(y: Column, start, w: int) -> Column:
    """w samples from a 0-based start."""
    start = start if isinstance(start, Column) else F.lit(start)
    return F.slice(y, (start + 1).cast("int"), F.lit(w))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def window_samples(sr: int, ms: float, least: int = 32) -> int:
    return max(least, int(sr * ms / 1000))


def fft_size(w: int) -> int:
    """The power of two that is at least twice the window."""
    return 2 ** math.ceil(math.log2(2 * w))


def hann(w: int) -> list[float]:
    return [0.5 - 0.5 * math.cos(2 * math.pi * j / (w - 1)) for j in range(w)]


def log_spectrum(x: Column, w: int) -> Column:
    """log1p magnitudes of the windowed frame's Fourier transform, by its definition."""
    n = fft_size(w)
    win = hann(w)
    rows = lambda f: F.array(*[F.array(*[F.lit(win[j] * f(2 * math.pi * k * j / n)) for j in range(w)]) for k in range(n // 2 + 1)])
    re = F.transform(rows(math.cos), lambda r: dot(r, x))
    im = F.transform(rows(math.sin), lambda r: dot(r, x))
    return F.zip_with(re, im, lambda a, b: F.log1p(F.sqrt(a * a + b * b)))


def spectral_distance(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y)) / (norm(a) + norm(b) + 1e-8)


def rms(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x) + 1e-12)


def jump(a: Column, b: Column) -> Column:
    """The relative difference of two levels."""
    return F.abs(a - b) / (a + b + 1e-8)


def differences(y: Column) -> Column:
    """|y[i + 1] - y[i]|."""
    n = F.size(y) - 1
    return F.zip_with(F.slice(y, F.lit(2), F.greatest(n, F.lit(0))), F.slice(y, F.lit(1), F.greatest(n, F.lit(0))), lambda a, b: F.abs(a - b))


def quantile(values: Column, q: float) -> Column:
    """The exact quantile of an array, by linear interpolation; null when empty."""
    s = F.array_sort(values)
    h = (F.size(s) - 1) * F.lit(q)
    lo = F.floor(h).cast("int")
    a, b = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(s) - 1))
    return a + (b - a) * (h - lo)


def peak_normalised(y: Column, to: float = 0.9) -> Column:
    """Scaled to a peak; unchanged where there is no level to scale."""
    peak = F.array_max(F.transform(y, lambda v: F.abs(v)))
    return F.when(peak >= 1e-8, F.transform(y, lambda v: v * to / peak)).otherwise(y)


def transitions(rows: DataFrame, w: int, pairs: int = 200, seed: int = 0) -> DataFrame:
    """Adds d and r: spectral distances and level jumps of random neighbouring windows inside each track.

    Starts are drawn by hash, so a track has the same ones in every run. Both are
    empty for a track of at most eight windows.
    """
    n, margin = F.size("y"), 2 * w
    count = F.least(F.lit(pairs), F.greatest(F.lit(1), F.floor((n - 2 * margin) / w).cast("int")))
    draws = F.when(n > 4 * margin, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("starts", F.transform(draws, lambda b: hash_index(seed, n - 6 * w, F.col("id"), b).cast("int") + margin))
    two = lambda s: (at(F.col("y"), s, w), at(F.col("y"), s + w, w))
    rows = rows.withColumn("d", F.transform("starts", lambda s: spectral_distance(log_spectrum(two(s)[0], w), log_spectrum(two(s)[1], w))))
    return rows.withColumn("r", F.transform("starts", lambda s: jump(rms(two(s)[0]), rms(two(s)[1])))).drop("starts")


def seam_report(rows: DataFrame, w: int, sr: int = 1000, pairs: int = 200, seed: int = 0) -> DataFrame:
    """The seam between each track's end and start against the track's own transitions; tracks of fewer than four windows are left out."""
    y, n = F.col("y"), F.size("y")
    rows = transitions(rows.where(n >= 4 * w), w, pairs, seed)
    end, start = at(y, n - w, w), at(y, 0, w)
    rows = rows.withColumn("seam", spectral_distance(log_spectrum(end, w), log_spectrum(start, w))).withColumn("seam_jump", jump(rms(end), rms(start)))
    near = max(1, int(sr * 0.001))
    joined = differences(F.concat(at(y, n - near, near), at(y, 0, near + 1)))
    rows = rows.withColumn("click", F.array_max(joined) / (quantile(differences(y), 0.99) + 1e-8))
    rows = rows.withColumn("median", F.coalesce(quantile(F.col("d"), 0.5), F.col("seam"))).withColumn("p95", F.coalesce(quantile(F.col("d"), 0.95), F.col("seam")))
    return rows.select(
        "id", F.col("seam").alias("seam_spectral_dist"), F.col("median").alias("internal_median"), F.col("p95").alias("internal_p95"),
        (F.col("seam") / (F.col("median") + 1e-8)).alias("seam_score"), (F.col("seam") <= F.col("p95")).alias("seam_ok_p95"),
        F.col("seam_jump").alias("seam_rms_jump"), F.coalesce(F.col("seam_jump") / (quantile(F.col("r"), 0.5) + 1e-8), F.lit(NAN)).alias("rms_score"),
        F.col("click").alias("click_ratio"), (F.col("click") <= 1.0).alias("click_ok"), F.size("d").alias("n_internal_pairs"))


def best_loop(rows: DataFrame, w: int, hop: int, least: float = 0.5) -> DataFrame:
    """The cut of the start or of the end whose seam is smallest; the naive loop wins ties, then the start, then the smaller cut."""
    y, n = F.col("y"), F.size("y")
    rows = rows.where(n >= 4 * w).withColumn("least", F.floor(n * F.lit(least)).cast("int"))
    rows = rows.withColumn("s0", log_spectrum(at(y, 0, w), w)).withColumn("s1", log_spectrum(at(y, n - w, w), w))
    rows = rows.withColumn("naive", spectral_distance(F.col("s1"), F.col("s0")))
    none = F.array().cast("array<int>")
    t_last = n - F.col("least") - w - 1
    heads = F.when(t_last >= hop, F.sequence(F.lit(hop), t_last, F.lit(hop))).otherwise(none)
    e_least = F.greatest(F.col("least"), F.lit(w)) + 1
    tails = F.when(n - hop >= e_least, F.sequence(n - hop, e_least, F.lit(-hop))).otherwise(none)
    option = lambda d, turn, place, cut: F.struct(d.alias("d"), F.lit(turn).alias("turn"), place.alias("place"), cut.alias("cut"))
    a = F.transform(heads, lambda t: option(spectral_distance(log_spectrum(at(y, t, w), w), F.col("s1")), 1, t, t))
    b = F.transform(tails, lambda e: option(spectral_distance(log_spectrum(at(y, e - w, w), w), F.col("s0")), 2, -e, e))
    rows = rows.withColumn("best", F.array_min(F.concat(F.array(option(F.col("naive"), 0, F.lit(0), F.lit(0))), a, b)))
    best = F.col("best")
    lo = F.when(best.turn == 1, best.cut).otherwise(0)
    hi = F.when(best.turn == 2, best.cut).otherwise(n)
    return rows.select("id", F.col("naive").alias("naive_seam_dist"), F.element_at(F.array(F.lit("naive"), F.lit("cut_start"), F.lit("cut_end")), best.turn + 1).alias("best_variant"),
                       best.cut.alias("best_cut_sample"), lo.alias("loop_start"), hi.alias("loop_end"), best.d.alias("best_seam_dist"), (F.col("naive") - best.d).alias("improvement_over_naive"))


def frames(y: Column, w: int, hop: int) -> Column:
    """All full frames, uncentred."""
    last = F.size(y) - w
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(hop)), lambda s: at(y, s, w))).otherwise(F.array().cast("array<array<double>>"))


def frame_rms_db(y: Column, w: int) -> Column:
    return F.transform(frames(y, w, w // 2), lambda f: F.lit(20.0) * F.log10(F.greatest(F.sqrt(mean(F.transform(f, lambda v: v * v))), F.lit(1e-12))))


def silent_fraction(y: Column, w: int, below: float = -50.0) -> Column:
    db = frame_rms_db(y, w)
    return F.when(F.size(db) > 0, F.size(F.filter(db, lambda v: v < below)) / F.size(db)).otherwise(1.0)


def flatness(spectrum: Column) -> Column:
    """Geometric over arithmetic mean of the power of a log1p spectrum, floored at 1e-10."""
    power = F.transform(spectrum, lambda v: F.greatest(F.lit(1e-10), F.expm1(v) * F.expm1(v)))
    return F.exp(mean(F.transform(power, lambda p: F.log(p)))) / mean(power)


def flux(spectra: Column) -> Column:
    """The mean rise between neighbouring normalised log spectra; 0 for fewer than two."""
    unit = F.transform(spectra, lambda s: F.transform(s, lambda v: v / (norm(s) + 1e-8)))
    n = F.size(unit) - 1
    rise = F.zip_with(F.slice(unit, F.lit(1), F.greatest(n, F.lit(0))), F.slice(unit, F.lit(2), F.greatest(n, F.lit(0))), lambda a, b: total(F.zip_with(a, b, lambda x, y: F.greatest(y - x, F.lit(0.0)))))
    return F.when(n > 0, mean(rise)).otherwise(0.0)


#: Thresholds before calibration; fixed values.
DEFAULTS = {"peak_dbfs_min": -40.0, "silent_frac_max": 0.90, "spectral_flatness_max": 0.30, "spectral_flux_min": 0.05}


def degeneracy_reasons(peak_dbfs: Column, silent: Column, flat: Column, moving: Column, thresholds: dict | None = None) -> Column:
    """The reasons why an output is no music, in a fixed order; NaN gives none."""
    t = DEFAULTS | (thresholds or {})
    lim = {k: v if isinstance(v, Column) else F.lit(v) for k, v in t.items()}
    over = lambda a, b: ~F.isnan(a) & (a > b)
    return F.array_compact(F.array(
        F.when(peak_dbfs < lim["peak_dbfs_min"], "silent_output"), F.when(over(silent, lim["silent_frac_max"]), "mostly_silence"),
        F.when(over(flat, lim["spectral_flatness_max"]), "noise_like"), F.when(moving < lim["spectral_flux_min"], "static_signal")))


#: Key profiles of Krumhansl and Kessler, from C; fixed values.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def correlation(a: Column, b: Column) -> Column:
    ma, mb = mean(a), mean(b)
    da, db = F.transform(a, lambda x: x - ma), F.transform(b, lambda x: x - mb)
    return dot(da, db) / F.sqrt(dot(da, da) * dot(db, db))


def key_profiles(unit: bool = False) -> Column:
    """The 24 templates in the order in which ties are decided: by tonic, major first; ``unit`` centres and normalises them."""
    items = []
    for s in range(12):
        for kind, base, sig in (("major", MAJOR, s), ("minor", MINOR, (s + 3) % 12)):
            rolled = [base[(j - s) % 12] for j in range(12)]
            if unit:
                m = sum(rolled) / 12
                size = math.sqrt(sum((x - m) ** 2 for x in rolled))
                rolled = [(x - m) / size for x in rolled]
            items.append(F.struct(F.lit(f"{NAMES[s]} {kind}").alias("key"), F.lit(sig).alias("sig"), F.array(*map(F.lit, rolled)).alias("p")))
    return F.array(*items)


def key_of(chroma: Column) -> Column:
    """struct(key, score, sig) of a 12-part chroma vector; undetermined where it is flat.

    A centred unit template's product with the vector, over the vector's spread, is their correlation.
    """
    spread = F.sqrt(F.greatest(F.lit(0.0), F.aggregate(chroma, F.lit(0.0), lambda t, x: t + x * x) - total(chroma) * total(chroma) / 12))
    scored = F.transform(key_profiles(unit=True), lambda t, i: F.struct(dot(chroma, t["p"]).alias("s"), i.alias("i"), t["key"].alias("key"), t["sig"].alias("sig")))
    ranked = F.transform(scored, lambda t: F.struct((-F.round(t["s"] / spread, 9)).alias("s"), t["i"].alias("i"), t["key"].alias("key"), t["sig"].alias("sig")))
    best = F.array_min(ranked)
    flat = F.struct(F.lit("undetermined").alias("key"), F.lit(0.0).alias("score"), F.lit(-1).alias("sig"))
    return F.when(spread / 12**0.5 < 1e-8, flat).otherwise(F.transform(F.array(best), lambda b: F.struct(b["key"].alias("key"), (-b["s"]).alias("score"), b["sig"].alias("sig")))[0])


def lag_profile(vectors: Column, lag: Column) -> Column:
    """The mean cosine of frames ``lag`` apart."""
    n = F.size(vectors)
    return mean(F.zip_with(F.slice(vectors, F.lit(1), n - lag), F.slice(vectors, lag + 1, n - lag), lambda a, b: dot(a, b)))


def unit_vectors(vectors: Column) -> Column:
    return F.transform(vectors, lambda v: F.transform(F.array(norm(v) + 1e-8), lambda n: F.transform(v, lambda x: x / n))[0])


def regularity(rows: DataFrame, vectors: str, least_lag: int) -> DataFrame:
    """Adds ratio, peak_lag and n_lags: the strongest lag of the self-similarity against the mean; NaN, -1 and 0 for short tracks.

    Unit vectors and the profile are columns of their own, so neither is worked out again for each lag.
    """
    most = F.floor(F.size(vectors) / 2).cast("int")
    rows = rows.withColumn("_unit", unit_vectors(F.col(vectors))).withColumn("_most", most)
    lags = F.when(F.col("_most") > least_lag + 2, F.sequence(F.lit(least_lag), F.col("_most") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_profile", F.transform(lags, lambda k: F.struct((-lag_profile(F.col("_unit"), k)).alias("s"), k.alias("k"))))
    peak = F.array_min("_profile")
    level = mean(F.transform("_profile", lambda p: -p["s"]))
    some = F.size("_profile") > 0
    return rows.select(*[c for c in rows.columns if c not in ("_unit", "_most", "_profile")], F.when(some, -peak["s"] / (level + 1e-8)).otherwise(F.lit(NAN)).alias("ratio"),
                       F.when(some, peak["k"]).otherwise(-1).alias("peak_lag"), F.size("_profile").alias("n_lags"))
