"""Queries over generated audio: whole reports, without an SQL equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.signal_udf import track_reports
from ..sources.audio import generate
from .catalog import query


@query()
def game_report(t):
    """Reports of one generated track per part brand: the brand's number picks generator and seed."""
    brands = t.part.select("p_brand").distinct().select(F.col("p_brand").alias("id"), F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int").alias("seed"))
    kinds = F.array(*map(F.lit, ("sine", "clicks", "melody", "noise", "silence")))
    plan = brands.select("id", "seed", F.get(kinds, F.col("seed") % 5).alias("generator"), F.lit(12.0).alias("seconds"))
    r = track_reports(generate(plan).select("id", F.lit(22050).alias("sr"), "samples"))
    return r.select("id", "error", F.col("report.seam_naive_ok").alias("seam_naive_ok"), F.col("report.best_loop.best_variant").alias("best_variant"),
                    F.round("report.grid_naive.bpm", 2).alias("bpm"), F.round("report.degeneracy.spectral_flatness", 4).alias("flatness"), F.round("report.degeneracy.spectral_flux", 4).alias("flux"),
                    F.col("report.structure.global_key").alias("key"))
