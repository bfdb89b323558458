"""Known answers of the signal and distance kernels, and properties of the statistics."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resonant.functions import hashing, stats
from resonant.operators import distances as D
from resonant.operators import signal_udf as U
from resonant.operators import signals as S
from resonant.sources import audio as A

SR = 22050


def test_smooth_seam_passes_and_hard_seam_does_not():
    assert U.seam(A.sine(220, 4), SR, 50.0)["seam_ok_p95"]
    hard = np.concatenate([A.sine(220, 2), A.sine(880, 2, phase=1.7)])
    assert U.seam(hard, SR, 50.0)["seam_score"] > U.seam(A.sine(220, 4), SR, 50.0)["seam_score"]


def test_step_is_a_click():
    y = A.sine(220, 4).copy()
    y[-SR // 2 :] += 0.4
    assert not U.seam(y, SR, 50.0)["click_ok"]


def test_best_loop_cuts_a_foreign_tail_and_never_loses():
    y = np.concatenate([A.sine(220, 4), A.sine(700, 1)])
    got = U.best_loop(y, SR)
    assert got["best_seam_dist"] <= got["naive_seam_dist"] and got["loop_duration_s"] >= 2.5 - 1e-6
    assert got["best_variant"] == "cut_end" and got["loop_end_s"] <= 4.1


def test_short_track_falls_back():
    w = S.window_samples(SR, 50)
    got = U.seam(A.sine(220, 6 * w / SR), SR, 50.0)
    assert got["n_internal_pairs"] == 0 and got["seam_ok_p95"] and abs(got["seam_score"] - 1) < 1e-4
    with pytest.raises(ValueError):
        U.seam(np.zeros(3 * w, np.float32), SR, 50.0)


def test_tempo_and_grid_of_clicks():
    env = U.onset_envelope(A.clicks(20, 120), SR)
    bpm = U.tempo(env, SR)
    assert abs(bpm - 120) < 1
    times = U.beats(env, SR, bpm)
    assert U.grid(times, bpm, 0, 16.0)["bar_fraction_error"] < 0.1
    assert U.grid(times, bpm, 0, 17.0)["bar_fraction_error"] > 0.4  # eight and a half bars
    assert U.grid(times[:3], bpm, 0, 16.0)["degenerate"]


def test_octave_fold_and_key():
    assert [U.fold_octave(v, 120) for v in (240, 60, 130, 0)] == [120, 120, 130, 0]
    triad = np.zeros(12)
    triad[[0, 4, 7]] = 1
    assert U.key(triad)[0] == "C major" and U.key(np.roll(triad, 7))[2] == 7 and U.key(np.ones(12))[2] == -1


def test_degenerate_signals():
    for y, reason in ((np.zeros(5 * SR, np.float32), "mostly_silence"), (A.noise(5), "noise_like"), (A.sine(220, 5), "static_signal")):
        f = U.features(y, SR, U.onset_envelope(y, SR))
        met = {"mostly_silence": f["silent_frac"] > 0.9, "noise_like": f["spectral_flatness"] > 0.3, "static_signal": f["spectral_flux"] < 0.05}
        assert met[reason]
    f = U.features(A.melody(5), SR, U.onset_envelope(A.melody(5), SR))
    assert f["spectral_flatness"] < 0.3 and f["spectral_flux"] > 0.05


def test_expressions_equal_numpy(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=40)
    row = spark.createDataFrame([(1, y.tolist())], "id long, y array<double>")
    got = row.select(S.log_spectrum(S.at(F.col("y"), 3, 8), 8).alias("s"), S.quantile(F.col("y"), 0.95).alias("q")).first()
    assert np.allclose(got.s, U.spectra(y[None, 3:11])[0]) and math.isclose(got.q, np.percentile(y, 95))
    loop = S.best_loop(row, 8, 4).first()
    assert loop.best_seam_dist <= loop.naive_seam_dist


def test_frechet_and_kad(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(60, 5)), rng.normal(0.3, 1.2, size=(50, 5))
    cov = lambda x: np.cov(x.T)
    ca, cb = cov(a), cov(b)
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(ca + cb) - 2 * np.sqrt(np.maximum(np.linalg.eigvals(ca @ cb).real, 0)).sum()
    frame = lambda x, base: spark.createDataFrame([(base + i, i % 4, v.tolist()) for i, v in enumerate(x)], "id long, file long, x array<double>")
    fa, fb = frame(a, 0), frame(b, 1000)
    assert math.isclose(D.frechet_distance(fa, fb, 5).first().fad, want, rel_tol=1e-8)
    k = lambda x, y: np.exp(-((x[:, None] - y[None]) ** 2).sum(2) / 2)
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    sums = [D.kernel_sums(x, y, 1.0, size=20).agg(F.sum("s").alias("s"), F.sum("trace").alias("t")).first() for x, y in ((fa, fa), (fb, fb), (fa, fb))]
    got = D.kad_from_sums(sums[0].s, sums[0].t, 60, sums[1].s, sums[1].t, 50, sums[2].s)
    assert math.isclose(got, off(k(a, a)) + off(k(b, b)) - 2 * k(a, b).mean(), rel_tol=1e-9)


def test_t_quantiles():
    for df, want in ((1, 12.706204736174676), (2, 4.302652729749459), (3, 3.182446305283706), (4, 2.7764451051977908)):
        assert math.isclose(stats.t_quantile(df), want, rel_tol=1e-9)


def test_wilson_edges(spark):
    rows = spark.createDataFrame([(k, n) for n in (0, 1, 7, 60) for k in range(0, n + 1)], "k long, n long").select("k", "n", stats.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    for r in rows:
        if r.n == 0:
            assert math.isnan(r.w.p)
        else:
            assert -1e-12 <= r.w.ci_lo <= r.w.p + 1e-12 and r.w.p - 1e-12 <= r.w.ci_hi <= 1 + 1e-12


def test_shards_partition_and_equal_python(spark):
    names = [f"m{i}|{d}" for i in range(30) for d in (15.0, 30.0)]
    rows = spark.createDataFrame([(n,) for n in names], "k string").select("k", *[hashing.md5_mod(F.col("k"), n).alias(f"s{n}") for n in (2, 3, 4, 7)]).collect()
    for r in rows:
        assert all(r[f"s{n}"] == int(hashlib.md5(r.k.encode()).hexdigest(), 16) % n for n in (2, 3, 4, 7))


@given(st.integers(0, 4), st.integers(0, 7), st.integers(0, 11), st.integers(0, 4), st.integers(0, 7), st.integers(0, 11))
def test_seeds_are_unique(a, b, c, x, y, z):
    seed = lambda s, p, t: 100000 * s + 1000 * p + t
    assert (seed(a, b, c) == seed(x, y, z)) == ((a, b, c) == (x, y, z))
