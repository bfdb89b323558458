"""From reports of single tracks to cells (model, duration) and the decision.

A report row holds model_id, duration_s, prompt_id, loop_eval, clap_score,
actual_duration_s and the structs degeneracy, game and structure, of which
missing ones are null. Every step is a grouped aggregate; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nan, stats
from .bootstrap import resampled, weighted_mean

CELL = ["model_id", "duration_s"]
VARIANTS = ("naive", "best")
#: Parameters of the decision; fixed values.
RULE = {"seam_pass_fraction_min": 0.5, "grid_pass_fraction_min": 0.5, "seam_gap_beat_error_max": 0.1, "bar_fraction_error_max": 0.1, "clap_share_min": 0.5}

#: Means with intervals by name: the field, and whether only tracks that loop count.
MEANS = {
    "seam_score_50ms": ("game.seam_50ms.seam_score", True), "seam_score_200ms": ("game.seam_200ms.seam_score", True), "best_seam_score": ("game.best_loop.best_seam_score", True),
    "best_loop_duration_s": ("game.best_loop.loop_duration_s", True), "seam_gap_beat_error_naive": ("game.grid_naive.seam_gap_beat_error", True),
    "bar_fraction_error_naive": ("game.grid_naive.bar_fraction_error", True), "regularity": ("structure.regularity_ratio", False), "tempo_cv": ("structure.tempo_cv", False),
    "key_drift": ("structure.key_drift_fraction", False), "actual_duration_s": ("actual_duration_s", False), "clap": ("clap_score", False)}


def loops() -> Column:
    """Whether a track counts for seams and grids: its prompt loops (by default it does) and it was measured."""
    return F.coalesce(F.col("loop_eval"), F.lit(True)) & F.col("game").isNotNull()


def is_degenerate() -> Column:
    """A degenerate output does not pass; it is not left out either."""
    return F.coalesce(F.col("degeneracy.degenerate"), F.lit(False))


def seam_passes(variant: str) -> Column:
    """Both windows and the click for the whole track as a loop, or the best loop's own verdict."""
    ok = F.col("game.seam_naive_ok") if variant == "naive" else F.col("game.best_loop.best_seam_ok_p95")
    return ~is_degenerate() & F.coalesce(ok, F.lit(False))


def grid_passes(variant: str, rule: dict = RULE) -> Column:
    """The loop's gap and bars fit the beat grid; a track without a grid does not pass."""
    g = F.col(f"game.grid_{'naive' if variant == 'naive' else 'best_loop'}")
    fits = nan.at_most(g["seam_gap_beat_error"], rule["seam_gap_beat_error_max"]) & nan.at_most(g["bar_fraction_error"], rule["bar_fraction_error_max"])
    return ~is_degenerate() & ~F.coalesce(g["degenerate"], F.lit(False)) & fits


def cell_proportions(reports: DataFrame, rule: dict = RULE) -> DataFrame:
    """Per cell: n_tracks, n_loop_tracks and the Wilson intervals of the shares that are degenerate or pass, by variant."""
    loop = loops()
    share = lambda c: stats.wilson(F.count_if(loop & c), F.count_if(loop))
    passes = []
    for v in VARIANTS:
        seam, grid = seam_passes(v), grid_passes(v, rule)
        passes += [share(seam).alias(f"seam_pass_{v}"), share(grid).alias(f"grid_pass_{v}"), share(seam & grid).alias(f"seam_and_grid_pass_{v}")]
    return reports.groupBy(*CELL).agg(
        F.count("*").alias("n_tracks"), F.count_if(loop).alias("n_loop_tracks"), stats.wilson(F.count_if(is_degenerate()), F.count("*")).alias("degenerate"), *passes)


def cell_reasons(reports: DataFrame) -> DataFrame:
    """(model_id, duration_s, reason, n)."""
    return reports.select(*CELL, F.explode("degeneracy.reasons").alias("reason")).groupBy(*CELL, "reason").agg(F.count("*").alias("n"))


def cell_means(reports: DataFrame, key: list[str], resamples: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Per cell and name of ``MEANS``: a struct (point, ci_lo, ci_hi, n_observations), undefined where no value is finite.

    All means of a cell share their resamples, drawn once for each track.
    """
    value = lambda path, own: nan.finite_or_null(F.when(loops(), F.col(path).cast("double")) if own else F.col(path).cast("double"))
    flat = reports.select(*CELL, *[F.col(k) for k in key], *[value(*of).alias(f"v_{n}") for n, of in MEANS.items()])
    boot = resampled(flat, CELL, key, {n: F.when(F.sum(F.when(F.col(f"v_{n}").isNotNull(), F.col("w"))) > 0, weighted_mean(F.col(f"v_{n}"), F.col("w"))) for n in MEANS}, resamples, seed)
    p = lambda n, q: F.coalesce(F.percentile(n, F.lit(q)), F.lit(nan.NAN))
    ci = boot.groupBy(*CELL).agg(*[F.struct(p(n, (1 - level) / 2).alias("ci_lo"), p(n, (1 + level) / 2).alias("ci_hi")).alias(f"ci_{n}") for n in MEANS])
    point = flat.groupBy(*CELL).agg(*[F.struct(nan.or_nan(F.avg(f"v_{n}")).alias("point"), F.count(f"v_{n}").alias("n")).alias(f"p_{n}") for n in MEANS])
    return point.join(ci, CELL).select(*CELL, *[
        F.struct(F.col(f"p_{n}.point").alias("point"), F.col(f"ci_{n}.ci_lo").alias("ci_lo"), F.col(f"ci_{n}.ci_hi").alias("ci_hi"), F.col(f"p_{n}.n").alias("n_observations")).alias(n) for n in MEANS])


def prompt_means(reports: DataFrame) -> DataFrame:
    """(model_id, duration_s, prompt_id, clap): the mean score of each prompt that has one."""
    return reports.where("clap_score is not null").groupBy(*CELL, "prompt_id").agg(F.avg("clap_score").alias("clap"))


def per_track_summary(reports: DataFrame, key: list[str], rule: dict = RULE, resamples: int = 1000) -> DataFrame:
    """One row for each cell: proportions, reasons and per-prompt scores as maps, and means with intervals."""
    reasons = cell_reasons(reports).groupBy(*CELL).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("degenerate_reasons"))
    claps = prompt_means(reports).groupBy(*CELL).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prompt_id", "clap")))).alias("clap_by_prompt"))
    return cell_proportions(reports, rule).join(cell_means(reports, key, resamples), CELL).join(reasons, CELL, "left").join(claps, CELL, "left")


def decide(reports: DataFrame, rule: dict = RULE) -> DataFrame:
    """(verdict_key, model_id, duration_s, variant, seam, grid, clap, pass, branch).

    Seam and grid hold by the lower bounds of the shares that pass. The score holds
    where a model lies above the median of all models of that duration for at least
    ``clap_share_min`` of its prompts. The branch is 2 if any verdict passes.
    """
    means = prompt_means(reports)
    medians = means.groupBy("duration_s", "prompt_id").agg(F.median("clap").alias("median"))
    told = means.join(medians, ["duration_s", "prompt_id"]).where(nan.finite(F.col("median")))
    above = told.groupBy(*CELL).agg((F.count_if(nan.above(F.col("clap"), F.col("median"))) >= rule["clap_share_min"] * F.count("*")).alias("clap"))
    cells = cell_proportions(reports, rule).join(above, CELL, "left")
    seam = lambda v: nan.at_least(F.col(f"seam_pass_{v}.ci_lo"), rule["seam_pass_fraction_min"])
    grid = lambda v: nan.at_least(F.col(f"grid_pass_{v}.ci_lo"), rule["grid_pass_fraction_min"])
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), seam(v).alias("seam"), grid(v).alias("grid")) for v in VARIANTS]))
    rows = cells.select(*CELL, F.coalesce("clap", F.lit(False)).alias("clap"), each.alias("x")).select(*CELL, "x.variant", "x.seam", "x.grid", "clap")
    rows = rows.withColumn("pass", F.col("seam") & F.col("grid") & F.col("clap"))
    branch = rows.agg(F.when(F.bool_or("pass"), 2).otherwise(1).alias("branch"))  # one row
    name = F.concat_ws("|", "model_id", F.format_string("%.1f", F.col("duration_s")), "variant")
    return rows.crossJoin(F.broadcast(branch)).select(name.alias("verdict_key"), *CELL, "variant", "seam", "grid", "clap", "pass", "branch")


def distributional_summary(sets: DataFrame, metrics: tuple[str, ...] = ("fad", "kad")) -> DataFrame:
    """Per cell and metric: mean over sets, interval between sets, mean bootstrap interval and their envelope.

    ``sets`` holds model_id, duration_s, and for each metric its value and a struct {metric}_boot (ci_lo, ci_hi).
    """
    aggregates = []
    for m in metrics:
        aggregates += [stats.between_set(F.col(m)).alias(f"{m}_between"), F.avg(f"{m}_boot.ci_lo").alias(f"{m}_lo"), F.avg(f"{m}_boot.ci_hi").alias(f"{m}_hi")]
    rows = sets.groupBy(*CELL).agg(*aggregates)
    own = lambda m: F.struct(
        F.lit(m).alias("metric"), F.col(f"{m}_between.mean").alias("mean"), F.col(f"{m}_between.k").alias("k"), F.col(f"{m}_between.ci_lo").alias("between_lo"), F.col(f"{m}_between.ci_hi").alias("between_hi"),
        F.col(f"{m}_lo").alias("boot_lo"), F.col(f"{m}_hi").alias("boot_hi"), stats.combined(F.col(f"{m}_between.ci_lo"), F.col(f"{m}_between.ci_hi"), F.col(f"{m}_lo"), F.col(f"{m}_hi")).alias("combined"))
    return rows.select(*CELL, F.explode(F.array(*map(own, metrics))).alias("x")).select(*CELL, "x.*")


def report_table(measured: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Report rows from measured tracks: report (as of ``track_reports``), orig_peak and the manifest's own columns.

    The degeneracy rule is laid over the features; a track that could not be measured
    keeps its row, without game and structure.
    """
    from .signals import degeneracy_reasons

    f = F.col("report.degeneracy")
    reasons = degeneracy_reasons(nan.dbfs(F.col("orig_peak")), f["silent_frac"], f["spectral_flatness"], f["spectral_flux"], thresholds)
    none = F.col("report").isNull()
    flagged = F.when(~none, F.struct((F.size(reasons) > 0).alias("degenerate"), reasons.alias("reasons")))
    rest = [c for c in measured.columns if c not in ("report", "orig_peak", "error")]
    return measured.select(*rest, flagged.alias("degeneracy"), F.when(~none, F.col("report")).alias("game"), F.col("report.structure").alias("structure"))
