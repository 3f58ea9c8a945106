"""Typed settings from string parameters, per scope, and saving new defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUE_WORDS = ("1", "true", "t", "yes")


def _typed(raw: Column, default: object) -> Column:
    if isinstance(default, bool):
        return F.when(raw.isNull(), F.lit(default)).otherwise(F.lower(raw).isin(*TRUE_WORDS))
    if isinstance(default, int):
        return F.coalesce(raw.try_cast("int"), F.lit(default))
    if isinstance(default, float):
        return F.coalesce(raw.try_cast("double"), F.lit(default))
    return F.coalesce(raw, F.lit(default))


def typed(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """One row per scope with every setting cast to the type of its default.

    Text that does not parse falls back to the default. One aggregation with a
    conditional maximum per key, so the shuffle carries one row per scope.
    """
    picked = rows.groupBy("scope_id").agg(
        *[F.max(F.when(F.col("name") == key, F.col("value"))).alias(key) for key in defaults]
    )
    return picked.select("scope_id", *[_typed(F.col(k), d).alias(k) for k, d in defaults.items()])


def save(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows with the changed keys overwritten and new keys added."""
    kept = rows.join(changes, ["scope_id", "name"], "left_anti")
    return kept.select("scope_id", "name", "value").unionByName(changes.select("scope_id", "name", "value"))
