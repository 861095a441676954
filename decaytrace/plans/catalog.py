"""The registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def register(name: str, run: Run, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is already registered")
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        evidence_queries, feature_queries, interval_queries, lineage_queries, profile_queries,
        record_queries, source_queries,
    )
