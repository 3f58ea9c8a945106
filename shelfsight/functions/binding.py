"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    A lambda variable is the binding. Without it, filters pushed through
    projections copy long expressions into every place that names them.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections reuse instead of repeating.

    The optimizer copies a projected expression into filters above it and into
    each field access. A one-element ``explode`` is a boundary it keeps, so the
    value is computed once per row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
