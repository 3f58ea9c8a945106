"""First n rows per group, and positions within groups, without hot tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int, as_col: str | None = None) -> DataFrame:
    """First ``n`` rows per key in a total order.

    Written as ``row_number() <= n``, which Spark turns into a group limit that
    runs in every map task before the shuffle: a hot key sends at most n rows
    per task.
    """
    name = as_col or "_rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if as_col else kept.drop(name)


def nth_latest_at_most(df: DataFrame, keys: list[str], at: str, spread: str, n: int, shares: int = 64) -> DataFrame:
    """Per key a ``_bound`` that at least ``n`` values of ``at`` reach, so that the latest ``n`` rows do.

    Rows are dealt into ``shares`` shares by a hash of ``spread``, and the ``n``-th
    latest of the shares' latest values is the bound: it is null where fewer shares
    have any. Each share is one number in a hash aggregate; nothing is sorted.
    """
    latest = df.groupBy(*keys, F.pmod(F.xxhash64(spread), F.lit(shares)).alias("_share")).agg(F.max(at).alias("_latest"))
    return latest.groupBy(*keys).agg(F.get(F.sort_array(F.collect_list("_latest"), asc=False), F.lit(n - 1)).alias("_bound"))


def heavy_keys(df: DataFrame, keys: list[str], parts: int = 1000) -> DataFrame:
    """Keys that hold more than 1/``parts`` of all rows, with ``_n`` rows. At most ``parts`` keys can."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*")).scalar()
    return counts.filter(F.col("_n") * F.lit(parts) > total)


def with_blocks(df: DataFrame, keys: list[str], order: list[str], parts: int = 1000, splits: int = 256) -> DataFrame:
    """Add ``block``: consecutive ranges of ``order`` that cut heavy groups into small pieces.

    Light groups are one block. Heavy groups are cut at rows of a sample by hash,
    some four per piece, so equal leading values are cut by those that follow;
    any cut is right, since blocks only have to be ordered and non-overlapping.
    There are at most ``parts`` heavy groups with about ``splits`` cuts each,
    which bounds the table that is broadcast.
    """
    heavy = heavy_keys(df, keys, parts)
    value = F.struct(*order)
    chance = F.pmod(F.xxhash64(*order), F.col("_n")) < 4 * splits
    sample = df.join(F.broadcast(heavy), keys).filter(chance)
    cuts = sample.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("_all")).select(
        *keys, F.filter("_all", lambda c, i: i % 4 == 3).alias("_cuts")
    )
    return (
        df.join(F.broadcast(cuts), keys, "left")
        .withColumn("block", F.coalesce(F.size(F.filter("_cuts", lambda c: c < value)), F.lit(0)))
        .drop("_cuts")
    )
