"""How sides of a join that grow with the input are brought together.

Left to itself Spark copies a side to every task if its estimate is small. The
estimate is that of the files below; rows made from them by parsing, exploding
and joining texts are many times that, and the copy passes through the driver.
Both functions have Spark deal out both sides by the key instead. Small vocabularies
(categories, prices, rules per host) are left to Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def unique(side: DataFrame) -> DataFrame:
    """A side with one row per key: a hash table per partition, so the other side needs no sort."""
    return side.hint("shuffle_hash")


def many(side: DataFrame) -> DataFrame:
    """A side whose keys may have any number of rows: sorted, so that a hot key spills instead of filling a task."""
    return side.hint("merge")
