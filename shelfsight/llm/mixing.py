"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Every source asks for its weight's share of all words. A source stops at
``max_epochs`` times its size; what it cannot take is shared among the others by
weight until nobody is above its cap. A source then gives every document whole
times and, for the rest, documents in a seeded order once more until the target
is reached.

The plan is one row per source. The order inside a source is cut into hash
ranges; words per range are summed before any shuffle, and only the one range
in which a target falls is ordered document by document. A source with a third
of all rows is therefore nobody's group, and documents are chosen where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.llm.common import word_count, written

RANGE_DIGITS = 3  # 16 ** digits hash ranges per source


def cyclic_weights(sources: DataFrame, source: str, weights: list[float]) -> DataFrame:
    """Add ``weight`` to one row per source: the given weights by code point, null last, repeating.

    The window sees one row per source. UTF-8 bytes sort like code points.
    """
    order = Window.orderBy(F.col(source).isNull(), F.encode(source, "UTF-8"))
    given = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.get(given, (F.row_number().over(order) - 1) % len(weights)))


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Add ``target`` to rows with source_size and weight.

    Each round computes the level (words per unit of weight) that sources below
    their cap share and caps those above it. The level only rises, so capped
    sources stay capped. A round moves two sums, and there are at most as many
    rounds as sources. Without any words all targets are zero.
    """
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        above = F.col("weight") * level > cap
        capped, open_weight = sources.agg(
            F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))
        ).first()
        raised = (total - capped) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _seeded(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _range(key: Column) -> Column:
    return F.substring(key, 1, RANGE_DIGITS)


def mix_plan(
    sizes: DataFrame, weights: list[float], max_epochs: float, seed: int, id_col: str = "doc_id", source: str = "source"
) -> DataFrame:
    """One row per source of ``sizes`` (id, source, size).

    _source, source_size, weight, target, _whole (copies of every row), _last
    (all rows of earlier ranges have one more copy, later ones none), _cut (the
    last row of range _last that has one more).
    """
    keyed = sizes.select(F.col(source).alias("_source"), F.col(id_col).alias("_id"), "size", _seeded(id_col, seed).alias("_key"))
    keyed = keyed.withColumn("_range", _range(F.col("_key")))
    ranges = written(keyed.groupBy("_source", "_range").agg(F.sum("size").alias("_words")), "mix-ranges")
    totals = ranges.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    plan = water_fill(written(cyclic_weights(totals, "_source", weights), "mix-sources"), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))

    # the first range whose running total reaches the rest, per source
    running = ranges.withColumn("_after", F.sum("_words").over(Window.partitionBy("_source").orderBy("_range")))
    named = plan.select(F.col("_source").alias("_s"), "_rest")
    last = (
        running.join(named, F.col("_source").eqNullSafe(F.col("_s")))
        .filter((F.col("_rest") > 0) & (F.col("_after") >= F.col("_rest")))
        .groupBy("_s")
        .agg(F.min(F.struct("_range", (F.col("_after") - F.col("_words")).alias("_before"), "_rest")).alias("_m"))
        .select("_s", F.col("_m._range").alias("_last"), F.col("_m._before").alias("_before"), F.col("_m._rest").alias("_rest"))
    )
    # inside that range, row by row: a row that overshoots by more than it leaves short stays out
    upto = Window.partitionBy("_s").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("_before") + F.sum("size").over(upto)
    cuts = (
        keyed.join(last, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_last")))
        .withColumn("_total", total)
        .filter(
            (F.col("_total") - F.col("size") < F.col("_rest"))
            & (F.col("_total") - F.col("_rest") <= F.col("_rest") - (F.col("_total") - F.col("size")))
        )
        .groupBy("_s")
        .agg(F.max(F.struct("_key", "_id", "size")).alias("_cut"))
    )
    bounds = last.select("_s", "_last").join(cuts.withColumnRenamed("_s", "_c"), F.col("_s").eqNullSafe(F.col("_c")), "left")
    return plan.drop("_rest").join(bounds.drop("_c"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")


def mix_to_weights(
    docs: DataFrame,
    weights: list[float],
    max_epochs: float = 3.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep_text: bool = True,
) -> DataFrame:
    """All columns, with size, source_size, weight, target, copies and taken.

    size: words of the text, 0 for null. target: words wanted of the row's
    source. copies: how often the row goes into the mix; taken: copies * size.
    Rows of a source have floor(target / source_size) copies, and rows in the
    order of (md5(seed, id), id, size) one more until the target is reached, the
    last one only if that brings the sum nearer. A null source is a source, the
    last by weight. Repeated rows get the same copies. Input columns with the name of an output
    are replaced. An empty table gives an empty one.
    """
    sizes = written(docs.select(id_col, source, word_count(F.col(text)).alias("size")), "mix-sizes")
    plan = written(mix_plan(sizes, weights, max_epochs, seed, id_col, source), "mix-plan")
    rows = sizes if not keep_text else docs.withColumn("size", word_count(F.col(text)))
    rows = rows.drop("source_size", "weight", "target", "copies", "taken")
    key = _seeded(id_col, seed)
    more = (_range(key) < F.col("_last")) | (
        (_range(key) == F.col("_last"))
        & (F.struct(key.alias("_key"), F.col(id_col).alias("_id"), F.col("size")) <= F.col("_cut"))
    )
    return (
        rows.join(plan, F.col(source).eqNullSafe(F.col("_source")))
        .withColumn("copies", F.col("_whole") + F.coalesce(more, F.lit(False)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_source", "_whole", "_last", "_cut")
    )


def repeated(mix: DataFrame) -> DataFrame:
    """One row per copy, with ``copy`` from 1. Rows without copies are not in the mix."""
    return mix.filter(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
