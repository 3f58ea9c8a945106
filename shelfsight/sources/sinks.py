"""Table sinks. Appends add files; updates are committed as the rows they change."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.operators.joins import unique
from shelfsight.operators.jobs import usage_cost
from shelfsight.streaming.versions import VersionedTables


OPEN_FILES = 16
ROW_GROUP_BYTES = 16 << 20


@contextmanager
def _setting(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    """A setting of the session while the block runs."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def append(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Append to a parquet table and return the table as it now is.

    A task keeps a file open for each partition value it meets, so rows need no
    sort by partition, which large tasks would spill. A task that meets more
    values than ``OPEN_FILES`` sorts the rest. Row groups are small, because a
    task holds one for each open file.
    """
    writer = rows.write.mode("append")
    if not partition_by:
        writer.parquet(path)
    else:
        with _setting(rows.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", OPEN_FILES):
            writer.partitionBy(*partition_by).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return rows.sparkSession.read.parquet(path)


def candidate_rows(found: DataFrame) -> DataFrame:
    """Found images of every role as new candidates: pending, text columns never null, size in whole kilobytes."""
    return found.withColumns({
        "state": F.lit("pending"),
        "confidence": F.coalesce("confidence", F.lit(0.0)),
        "ai_reasoning": F.coalesce("ai_reasoning", F.lit("")),
        "image_mimetype": F.coalesce("image_mimetype", F.lit("")),
        "image_width": F.coalesce("image_width", F.lit(0)),
        "image_height": F.coalesce("image_height", F.lit(0)),
        "image_filesize_kb": F.floor(F.coalesce("image_bytes", F.lit(0)) / 1024).cast("int"),
    }).drop("image_bytes")


def step_rows(events: DataFrame) -> DataFrame:
    """Step log rows; messages are cut to 5000 characters."""
    return events.withColumn("message", F.substring("message", 1, 5000))


def usage_rows(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows with cost; missing token counts become zero and cost is stored as a decimal."""
    filled = calls.withColumn("input_tokens", F.coalesce("input_tokens", F.lit(0))).withColumn(
        "output_tokens", F.coalesce("output_tokens", F.lit(0))
    )
    return usage_cost(filled, prices).withColumn("cost_usd", F.col("cost_usd").cast("decimal(12,6)"))


def updated_rows(rows: DataFrame, updates: DataFrame, key: str = "product_id") -> DataFrame:
    """The rows that ``updates`` touch, as they are afterwards.

    An update has the key, a ``version``, ``columns`` (the names it sets, null
    values included) and values for columns of ``rows``. Per column the update with
    the highest version wins; of equal versions the greater value, null least.
    ``rows`` keeps the version that set a column in ``_versions``, so an update that
    is older than the row's value, or the same one again, changes nothing.
    """
    named = [c for c in updates.columns if c in rows.columns and c not in (key, "_versions")]
    newest = lambda c: F.max(F.when(F.array_contains("columns", c), F.struct("version", F.col(c).alias("value"))))
    latest = updates.groupBy(key).agg(*[newest(c).alias(f"_new_{c}") for c in named])
    joined = rows.join(unique(latest), key)
    known = lambda c: F.element_at("_versions", F.lit(c))
    newer = lambda c: F.coalesce(F.col(f"_new_{c}.version") > F.coalesce(known(c), F.lit(-1)), F.lit(False))
    versions = F.map_from_arrays(
        F.array(*[F.lit(c) for c in named]), F.array(*[F.greatest(F.col(f"_new_{c}.version").cast("long"), known(c)) for c in named])
    )
    rest = F.map_filter("_versions", lambda c, _: ~c.isin(named))
    return joined.select(
        *[F.when(newer(c), F.col(f"_new_{c}.value")).otherwise(F.col(c)).alias(c) if c in named else F.col(c) for c in rows.columns if c != "_versions"],
        F.map_concat(F.map_filter(versions, lambda _, v: v.isNotNull()), rest).alias("_versions"),
    )


def with_versions(rows: DataFrame) -> DataFrame:
    """Rows that no update has touched yet."""
    return rows.withColumn("_versions", F.expr("cast(map() as map<string, bigint>)"))


def merge_updates(store: VersionedTables, table: str, updates: DataFrame, batch: int) -> None:
    """Commit what ``updates`` change in a table of the store as one batch; a batch written again is the same."""
    (key,) = store.keys[table]
    store.commit(batch, {table: updated_rows(store.current(table, batch), updates, key)})
