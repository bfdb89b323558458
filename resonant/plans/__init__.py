"""Queries over the shared tables."""

from __future__ import annotations

from . import audio_queries, catalog, relational_queries, signal_queries, stats_queries, summary_queries  # noqa: F401


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLE_SQL)
