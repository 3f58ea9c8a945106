"""What several corpus operators share: tokens, folders, and tables that are written once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.session import shared_folder

# Words are runs of anything but blank, tab, line feed, vertical tab, form feed
# and carriage return. These are also the separators of Python's bytes.split().
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole_text(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """All words of a text, as an array."""
    return F.array_remove(F.split(whole_text(text), SEPARATORS), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written below the shared folder and read again.

    Cuts the plan: whatever reads the result twice does not compute it twice,
    and a lost executor costs one task, not the whole history.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls in the held-out remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
