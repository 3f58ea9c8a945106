"""Queries over jobs, spend and monitoring."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.operators import jobs as J
from shelfsight.operators.joins import unique
from shelfsight.plans.registry import query
from shelfsight.plans.tables import Tables

NOW = dt.datetime(2024, 1, 20, 12, 0)


def _moved(t: Tables) -> DataFrame:
    """Every job with an event that depends on its pipeline."""
    event = (
        F.when(F.col("pipeline_steps") == "discover_only", "queue")
        .when(F.col("pipeline_steps") == "discover_apply", "pause")
        .when(F.col("pipeline_steps") == "full", "cancel")
    )
    return J.transition(t("jobs"), event)


@query
def job_transition(t: Tables) -> DataFrame:
    return _moved(t).select("job_id", "old_state", "state", "requeued")


@query
def job_requeue(t: Tables) -> DataFrame:
    return J.requeue_pending(t("job_products"), _moved(t))


@query
def job_pick(t: Tables) -> DataFrame:
    return J.pick(t("jobs")).select("job_id", "state", "created_at")


@query
def job_chunk(t: Tables) -> DataFrame:
    return J.chunk(t("job_products")).select("job_id", "product_id", "place")


def _outcomes(t: Tables) -> DataFrame:
    return J.outcome(t("work_results"), t("jobs"), t("products"))


@query
def job_outcome(t: Tables) -> DataFrame:
    return _outcomes(t).withColumn("product_error", F.md5("product_error"))


@query
def job_progress(t: Tables) -> DataFrame:
    """One tick that works the first chunk of every job."""
    done = J.chunk(t("job_products")).select("job_id", "product_id")
    worked = J.outcome(t("work_results").join(unique(done), ["job_id", "product_id"]), t("jobs"), t("products"))
    after = J.progress(t("jobs"), t("job_products"), worked, NOW, _costs(t))
    return after.withColumn("actual_cost_usd", F.round("actual_cost_usd", 6))


@query
def job_close_empty(t: Tables) -> DataFrame:
    return J.close_empty(t("jobs"), t("job_products")).select("job_id", "state")


@query
def job_total_count(t: Tables) -> DataFrame:
    return J.total_count(t("job_products"))


def _costs(t: Tables) -> DataFrame:
    return J.usage_cost(t("usage_log"), t("price_table"))


@query
def usage_cost(t: Tables) -> DataFrame:
    return _costs(t).select("usage_id", "model", F.round("cost_usd", 9).alias("cost_usd"))


@query
def usage_month_to_date(t: Tables) -> DataFrame:
    return J.month_to_date(_costs(t), NOW).withColumn("spent_usd", F.round("spent_usd", 6))


@query
def job_spend(t: Tables) -> DataFrame:
    return J.job_spend(_costs(t)).withColumn("actual_cost_usd", F.round("actual_cost_usd", 6))


@query
def budget_decision(t: Tables) -> DataFrame:
    return J.budget_decision(t("jobs"), _costs(t), NOW, budget=50.0).select("job_id", "state", "budget_alert")


@query
def alert_rows(t: Tables) -> DataFrame:
    return J.alert_rows(t("jobs"), _costs(t), NOW, budget=50.0, address="ops@example.com")


@query
def job_log_view(t: Tables) -> DataFrame:
    return J.log_view(t("step_log"), t("jobs")).select("job_id", "log_id", "created_at", "step", "level", "duration_ms")


@query
def usage_log_view(t: Tables) -> DataFrame:
    return J.usage_view(_costs(t)).select("usage_id", "created_at", "model", "operation", F.round("cost_usd", 9).alias("cost_usd"))


@query
def job_list_view(t: Tables) -> DataFrame:
    return J.list_view(t("jobs"), t("job_products"), _costs(t)).select(
        "job_id", "state", "pipeline_steps", "created_at", "total_count", F.round("actual_cost_usd", 6).alias("actual_cost_usd")
    )
