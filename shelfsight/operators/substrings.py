"""Containment joins as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.operators.joins import many, unique
from shelfsight.session import materialized

GRAM = 4
FEW = 10_000


def _pieces(text: Column, n: Column | int) -> Column:
    """All substrings of ``n`` characters."""
    size = F.lit(n) if isinstance(n, int) else n
    length = F.length(text)
    return F.when(
        length >= size, F.transform(F.sequence(F.lit(1), length - size + 1), lambda i: F.substring(text, i, size))
    ).otherwise(F.array().cast("array<string>"))


def substring_hits(texts: DataFrame, text: str, needles: DataFrame, needle: str, keys: list[str], gram: int = GRAM) -> DataFrame:
    """Rows of ``texts`` paired with every needle their text contains, within equal ``keys``.

    No pair of text and needle is formed unless it matches on a rare piece. A
    needle of at least ``gram`` characters is found by the one of its ``gram``-character
    pieces that the fewest texts of its key have; shorter ones are pieces
    themselves. Texts are cut into their distinct pieces of ``gram`` characters and
    of the lengths of shorter needles, so how many they are does not depend on
    how many lengths needles have. Pieces that no needle of the key has are dropped
    in a semi-join; the rest is written, counted, and met with the needles' rarest
    pieces. Keys and hashes travel; the candidates get their rows back and are
    compared as texts. Repeated rows keep their number.
    """
    on = [*keys, "_piece"]
    size = F.length(needle)
    sizes = F.array_sort(F.collect_set(F.least(size, F.lit(gram)))).alias("_sizes")
    if keys:
        sized = texts.join(needles.groupBy(*keys).agg(sizes), keys)
    else:
        sized = texts.withColumn("_sizes", needles.agg(sizes).scalar())
    row = F.xxhash64(*texts.columns).alias("_row")
    hashed = lambda pieces: F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))
    own = F.when(size < gram, F.array(F.col(needle))).otherwise(_pieces(F.col(needle), gram))
    of_needles = needles.select(*keys, F.xxhash64(needle).alias("_needle"), F.explode(hashed(own)).alias("_piece")).distinct()
    cut = sized.select(*keys, row, F.explode(hashed(F.flatten(F.transform("_sizes", lambda n: _pieces(F.col(text), n))))).alias("_piece"))
    met = materialized(cut.join(many(of_needles.select(*on).distinct()), on, "left_semi"), "shared-pieces")
    rarity = met.groupBy(*on).agg(F.count("*").alias("_n"))
    # a piece without a row in ``rarity`` is in no text, and neither is its needle
    rated = of_needles.join(unique(rarity), on, "left").groupBy(*keys, "_needle").agg(
        F.min_by("_piece", F.struct(F.coalesce("_n", F.lit(0)), "_piece")).alias("_piece"))
    pairs = met.join(many(rated), on).select(*keys, "_row", "_needle").distinct()
    named = needles.withColumn("_needle", F.xxhash64(needle))
    found = texts.withColumn("_row", row).join(many(pairs), [*keys, "_row"]).join(many(named), [*keys, "_needle"])
    return found.filter(F.contains(F.col(text), F.col(needle))).drop("_row", "_needle")


def is_few(needles: DataFrame, few: int = FEW) -> bool:
    """Whether there are at most ``few`` rows."""
    return needles.limit(few + 1).count() <= few


def hits_of_few(texts: DataFrame, text: str, needles: DataFrame, needle: str, gram: int = GRAM) -> DataFrame:
    """``substring_hits`` without keys for few rows of ``needles``, which are copied to the texts; no text is shuffled.

    A needle is found by the one of its pieces that the fewest rows of needles have. A
    piece that a text has several times counts at its first place, so every
    row meets a needle once. Needles are not empty.
    """
    size = F.length(needle)
    known = needles.select(*[F.col(c).alias(f"_{c}") for c in needles.columns], F.col(needle).alias("_sought"))
    own = known.withColumn("_piece", F.explode(F.array_distinct(
        F.when(F.length("_sought") < gram, F.array("_sought")).otherwise(_pieces(F.col("_sought"), gram)))))
    shared = own.groupBy("_piece").agg(F.count("*").alias("_n"))
    rarest = own.join(shared, "_piece").groupBy("_sought").agg(F.min_by("_piece", F.struct("_n", "_piece")).alias("_piece"))
    keyed = known.join(rarest, "_sought")
    sizes = needles.agg(F.collect_set(F.least(size, F.lit(gram)))).scalar()
    places = F.length(text) - F.col("_size") + 1
    cut = (
        texts.withColumn("_size", F.explode(sizes))
        .withColumn("_place", F.explode(F.when(places > 0, F.sequence(F.lit(1), places))))
        .withColumn("_piece", F.substring(F.col(text), F.col("_place"), F.col("_size")))
    )
    found = cut.join(F.broadcast(keyed), "_piece").filter(
        F.contains(F.col(text), F.col("_sought")) & (F.position("_piece", text) == F.col("_place")))
    return found.select(*texts.columns, *[F.col(f"_{c}").alias(c) for c in needles.columns])
