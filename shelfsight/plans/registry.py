"""Registry of the runnable queries, filled by the ``queries_*`` modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from shelfsight.plans.tables import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}

_MODULES = (
    "queries_catalog", "queries_sources", "queries_discovery", "queries_candidates",
    "queries_recipes", "queries_raster", "queries_lifecycle", "queries_jobs", "queries_streams",
)


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register a function of the tables under its own name."""
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    for module in _MODULES:
        import_module(f"shelfsight.plans.{module}")

    def bind(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(Tables(spark, folder))

    return {name: bind(fn) for name, fn in _QUERIES.items()}
