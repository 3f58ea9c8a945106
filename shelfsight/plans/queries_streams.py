"""Streaming queries, run over everything available and then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.operators.jobs import usage_cost
from shelfsight.plans.registry import query
from shelfsight.plans.tables import Tables
from shelfsight.session import shared_folder
from shelfsight.streaming import queries as Q


def _stream(t: Tables, table: str, by: str, batches: int = 4) -> DataFrame:
    """The whole table as a stream of ``batches`` files in the order of ``by``, one file per batch, so state is carried along."""
    landed = shared_folder(t.spark, f"arrived-{table}")
    t.base(table).repartitionByRange(batches, by).write.parquet(landed)
    return t.spark.readStream.schema(t.base(table).schema).option("maxFilesPerTrigger", 1).parquet(landed)


@query
def stream_usage_budget(t: Tables) -> DataFrame:
    usage = _stream(t, "events", "ts").select(
        F.col("ts").alias("created_at"),
        F.expr("case event_id % 4 when 0 then 'small' when 1 then 'medium' when 2 then 'large' else 'unlisted' end").alias("model"),
        F.expr("(user_id * 37) % 5000").alias("input_tokens"),
        F.expr("(user_id * 13 + event_id) % 700").alias("output_tokens"),
    )
    target = shared_folder(t.spark, "budget")
    Q.usage_budget(usage, t("price_table"), target, shared_folder(t.spark, "budget-state")).awaitTermination()
    return Q.latest_months(t.spark.read.parquet(target)).withColumn("spent_usd", F.round("spent_usd", 6))


BUDGET_SHARE = 0.85
_WEEK = "cast(floor((day(created_at) - 1) / 7) as int)"


def _budget(t: Tables) -> float:
    """A share of all spend, so that it is reached on the way."""
    costs = usage_cost(t("usage_log"), t("price_table"))
    return round(costs.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).first()[0] * BUDGET_SHARE, 2)


@query
def stream_budget_alerts(t: Tables) -> DataFrame:
    """Alerts over a month of usage that lands week by week; the stream is started anew for each week."""
    budget, log = _budget(t), t("usage_log").select("created_at", "model", "input_tokens", "output_tokens")
    landed, target, checkpoint = (shared_folder(t.spark, n) for n in ("arrived-usage", "alerts", "alerts-state"))
    for number in range(5):
        log.filter(F.expr(_WEEK) == number).write.mode("append").parquet(landed)
        arrived = t.spark.readStream.schema(log.schema).parquet(landed)
        Q.budget_alerts(arrived, t("price_table"), budget, target, checkpoint).awaitTermination()
    return t.spark.read.parquet(target).select("month", "level", F.round("spent_usd", 6).alias("spent_usd"))


@query
def stream_job_ticks(t: Tables) -> DataFrame:
    """The job loop over a month of usage that lands week by week; the stream is started anew for each week.

    The budget is a share of all spend, so that early ticks work, one warns and a later one pauses the jobs.
    """
    budget, log = _budget(t), t("usage_log").select("created_at", "model", "input_tokens", "output_tokens", "job_id")
    landed, checkpoint = shared_folder(t.spark, "arrived-usage"), shared_folder(t.spark, "ticks-state")
    store = Q.tick_tables(t.spark, shared_folder(t.spark, "ticks"), t("jobs"), t("job_products"))
    for number in range(5):
        log.filter(F.expr(_WEEK) == number).write.mode("append").parquet(landed)
        arrived = t.spark.readStream.schema(log.schema).parquet(landed)
        Q.job_ticks(arrived, store, t("work_results"), t("products"), t("price_table"), budget, checkpoint, "ops@example.com").awaitTermination()
    alerts = store.current("alerts").select("at", "subject")
    told = alerts.agg(F.max("subject").alias("_subject")).scalar()
    return store.current("jobs").select(
        "job_id", "state", *[F.col(c).cast("long").alias(c) for c in ("success_count", "failure_count", "processed_count")],
        "white_bg_count", "rembg_count", F.round("actual_cost_usd", 6).alias("actual_cost_usd"), "started_at", "completed_at",
        F.substring(told, 1, 16).alias("last_alert"),
    )
