"""Structured Streaming queries. Each writes a table that a restart continues."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfsight.operators.jobs import CHUNK_SIZE, JOBS_PER_TICK, tick, usage_cost, with_job_columns
from shelfsight.streaming.versions import VersionedTables


def _trigger(writer, interval: str | None):
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def _replace_batch(rows: DataFrame, batch_id: int, target: str) -> None:
    """Write one batch under its own folder; a replayed batch overwrites itself."""
    rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def usage_budget(
    usage: DataFrame, prices: DataFrame, target: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Running spend per month as usage rows arrive.

    State is one row per month. Every batch writes the months it changed.
    """
    monthly = (
        usage_cost(usage, prices)
        .groupBy(F.date_trunc("month", "created_at").alias("month"))
        .agg(F.sum("cost_usd").alias("spent_usd"), F.count("*").alias("n_calls"))
    )
    writer = (
        monthly.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda rows, batch_id: _replace_batch(rows, batch_id, target))
    )
    return _trigger(writer, interval).start()


def latest_months(updates: DataFrame) -> DataFrame:
    """Current figure per month out of the written updates."""
    return updates.groupBy("month").agg(
        F.max_by("spent_usd", "batch").alias("spent_usd"), F.max_by("n_calls", "batch").alias("n_calls")
    )


ALERT_LEVELS = (("exhausted", 1.0), ("warning", 0.8))


def _partial_spend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per month and batch of rows, so that a month's rows do not all travel to the task that holds its state."""
    for rows in batches:
        rows = rows[rows["at"].notna()]
        month = rows["at"].dt.to_period("M").dt.to_timestamp()
        yield rows.groupby(month.rename("month")).agg(at=("at", "max"), cost_usd=("cost_usd", "sum")).reset_index()


def _crossings(budget: float):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the month is over and no row of it is awaited any more
            state.remove()
            return
        spent, told = state.get if state.exists else (0.0, 0)
        spent += sum(float(rows["cost_usd"].sum()) for rows in batches)
        reached = sum(spent >= share * budget for _, share in ALERT_LEVELS) if budget else 0
        state.update((spent, max(told, reached)))
        state.setTimeoutTimestamp(int((key[0] + pd.DateOffset(months=1)).timestamp() * 1000))
        new = [level for level, share in ALERT_LEVELS[::-1]][told:reached]
        if new:
            yield pd.DataFrame({"month": [key[0]] * len(new), "level": new, "spent_usd": [spent] * len(new)})

    return run


def budget_alerts(
    usage: DataFrame, prices: DataFrame, budget: float, target: str, checkpoint: str, late: str = "7 days", interval: str | None = None
) -> StreamingQuery:
    """One row per month and level (80 %, 100 % of the budget), when the month's spend first reaches it.

    Keyed state holds a month's spend and the level it was told, so neither later
    batches nor a restart tell it again; a jump over both gives both rows. A month
    leaves the state once the watermark, ``late`` behind the newest row, is past its
    end; rows that come later still are dropped. Session time zone UTC.
    """
    costs = usage_cost(usage, prices).select(F.col("created_at").cast("timestamp").alias("at"), "cost_usd")
    partial = costs.mapInPandas(_partial_spend, "month timestamp, at timestamp, cost_usd double").withWatermark("at", late)
    alerts = partial.groupBy("month").applyInPandasWithState(
        _crossings(float(budget)), "month timestamp, level string, spent_usd double", "spent double, told int", "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    writer = alerts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return _trigger(writer.foreachBatch(lambda rows, batch_id: _replace_batch(rows, batch_id, target)), interval).start()


TICK_TABLES = {
    "jobs": ["job_id"], "job_products": ["job_id", "product_id"], "months": ["month"],
    "product_errors": ["product_id"], "alerts": ["tick"],
}


def tick_tables(spark: SparkSession, root: str, jobs: DataFrame, job_products: DataFrame, fold_after: int = 20) -> VersionedTables:
    """The tables that ticks change, made at the first start and found again at later ones."""
    store = VersionedTables(spark, root, TICK_TABLES, fold_after)
    empty = lambda schema: spark.createDataFrame([], schema)
    store.create({
        "jobs": with_job_columns(jobs), "job_products": job_products.select("job_id", "product_id", "pending"),
        "months": empty("month timestamp_ntz, spent_usd double"),
        "product_errors": empty("product_id long, product_state string, product_error string"),
        "alerts": empty("tick long, at timestamp_ntz, email_to string, subject string, body string"),
    })
    return store


def job_ticks(
    usage: DataFrame, store: VersionedTables, results: DataFrame, products: DataFrame, prices: DataFrame, budget: float,
    checkpoint: str, address: str = "", interval: str | None = None, limit: int = JOBS_PER_TICK, size: int = CHUNK_SIZE,
) -> StreamingQuery:
    """The job loop as a stream of usage rows (``created_at, model, input_tokens, output_tokens, job_id``).

    Every batch is a tick at the time of its last row: it adds its rows to the
    month's spend and runs ``tick`` on the tables as of the last commit. Rows of a
    clock (null tokens) may be merged into the stream, so that ticks go on without
    usage. All changes of a tick are committed together under its batch id; a
    replayed batch reads the tables before that commit and writes the same rows.
    One query has one running batch, so two ticks never work at the same time.
    """

    def step(rows: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        costs = usage_cost(rows, prices).select("created_at", "job_id", "cost_usd").persist()
        try:
            now = costs.agg(F.max("created_at")).first()[0]
            if now is None:
                return
            months = store.current("months", version)
            month = F.date_trunc("month", "created_at").cast("timestamp_ntz")
            arrived = costs.filter(F.col("created_at").isNotNull()).groupBy(month.alias("month")).agg(F.sum("cost_usd").alias("_more"))
            spent = months.join(arrived, "month", "full").select(
                "month", (F.coalesce("spent_usd", F.lit(0.0)) + F.coalesce("_more", F.lit(0.0))).alias("spent_usd"))
            spend = spent.select(F.col("month").alias("created_at"), F.col("spent_usd").alias("cost_usd"))
            done = tick(store.current("jobs", version), store.current("job_products", version), results, products,
                        spend, costs, now, budget, address, limit, size)
            store.commit(version, {
                "jobs": done.jobs, "job_products": done.processed.withColumn("pending", F.lit(False)), "months": spent,
                "product_errors": done.products.dropDuplicates(["product_id"]),
                "alerts": done.alerts.select(F.lit(version).cast("long").alias("tick"), F.lit(now).cast("timestamp_ntz").alias("at"), "*"),
            })
        finally:
            costs.unpersist()

    return _trigger(usage.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step), interval).start()
