"""Batch jobs: state changes, chunks, progress, model spend and budget."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.operators.joins import unique
from shelfsight.operators.topk import first_n
from shelfsight.settings import DEFAULTS

JOBS_PER_TICK = 3
CHUNK_SIZE = 5
# fixed values: price of an unlisted model per million tokens in and out
UNLISTED_PRICE = (1.0, 5.0)


# ---- state ----

def transition(jobs: DataFrame, event: Column) -> DataFrame:
    """State after ``queue``, ``pause`` or ``cancel``; anything else leaves it alone."""
    s = F.col("state")
    moved = (
        F.when((event == "queue") & s.isin("draft", "paused"), "queued")
        .when((event == "pause") & s.isin("queued", "running"), "paused")
        .when((event == "cancel") & s.isin("draft", "queued", "running", "paused"), "cancelled")
    )
    return (
        jobs.withColumn("old_state", s)
        .withColumn("state", F.coalesce(moved, s))
        .withColumn("requeued", F.coalesce((event == "queue") & F.col("old_state").isin("draft", "paused"), F.lit(False)))
    )


def requeue_pending(job_products: DataFrame, moved_jobs: DataFrame) -> DataFrame:
    """Queueing marks every product of the job as pending again, also after a pause."""
    requeued = moved_jobs.filter("requeued").select("job_id", F.lit(True).alias("_requeued"))
    return job_products.join(unique(requeued), "job_id", "left").select(
        "job_id", "product_id", F.coalesce("_requeued", "pending").alias("pending")
    )


def pick(jobs: DataFrame, limit: int = JOBS_PER_TICK) -> DataFrame:
    """The oldest runnable jobs of this tick."""
    return jobs.filter(F.col("state").isin("queued", "running")).orderBy("created_at", "job_id").limit(limit)


def chunk(job_products: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """First pending products per job; each task keeps at most ``size`` per job before the shuffle."""
    return first_n(job_products.filter("pending"), ["job_id"], ["product_id"], size, "place")


def total_count(job_products: DataFrame) -> DataFrame:
    return job_products.groupBy("job_id").agg(F.count("*").alias("total_count"))


# ---- progress ----

def outcome(results: DataFrame, jobs: DataFrame, products: DataFrame) -> DataFrame:
    """What each processed product adds to its job, and its new error text.

    In a normalize-only job a product without an image still succeeds, and an
    unchanged or non-white result counts as a background removal.
    """
    joined = results.join(unique(jobs.select("job_id", "pipeline_steps")), "job_id").join(
        unique(products.select("product_id", "has_main_image")), "product_id"
    )
    ok = F.col("error").isNull()
    normalize = F.col("pipeline_steps") == "normalize_only"
    measured = ok & normalize & F.col("has_main_image")
    white = F.coalesce(F.col("was_white_bg") & ~F.col("skipped_unchanged"), F.lit(False))
    number = lambda c: F.when(c, 1).otherwise(0)
    return joined.select(
        "job_id",
        "product_id",
        number(ok).alias("success"),
        number(~ok).alias("failure"),
        F.when(normalize, number(measured & white)).when(ok, F.col("white_bg")).otherwise(0).alias("white_bg"),
        F.when(normalize, number(measured & ~white)).when(ok, F.col("rembg")).otherwise(0).alias("rembg"),
        F.when(~ok, "error").alias("product_state"),
        F.substring("error", 1, 5000).alias("product_error"),
    )


JOB_DEFAULTS = {
    "white_bg_count": "bigint", "rembg_count": "bigint", "actual_cost_usd": "double",
    "started_at": "timestamp_ntz", "completed_at": "timestamp_ntz",
}


def with_job_columns(jobs: DataFrame) -> DataFrame:
    """Counters, cost and times that a job has from its first tick on, for tables that lack them."""
    none = lambda kind: F.lit(None if kind == "timestamp_ntz" else 0).cast(kind)
    return jobs.withColumns({c: none(kind) for c, kind in JOB_DEFAULTS.items() if c not in jobs.columns})


def progress(
    jobs: DataFrame, job_products: DataFrame, outcomes: DataFrame, now: dt.datetime | None = None, costs: DataFrame | None = None
) -> DataFrame:
    """Jobs after one tick that processed ``outcomes``: counters, state, times and actual cost.

    Only queued and running jobs work; outcomes of others change nothing, their
    pending products included. A queued job that works has started ``now`` unless
    it had started before; a job with nothing left is completed ``now``. ``costs``
    (``job_id, cost_usd``) are the usage rows of this tick; they count for their
    job whatever its state.
    """
    added = outcomes.groupBy("job_id").agg(
        F.sum("success").alias("_success"), F.sum("failure").alias("_failure"), F.count("*").alias("_processed"),
        F.sum("white_bg").alias("_white"), F.sum("rembg").alias("_rembg"),
    )
    runnable = jobs.filter(F.col("state").isin("queued", "running")).select("job_id")
    done = outcomes.select("job_id", "product_id").join(unique(runnable), "job_id", "left_semi")
    left = (
        job_products.filter("pending")
        .join(unique(done), ["job_id", "product_id"], "left_anti")
        .groupBy("job_id").agg(F.count("*").alias("_left"))
    )
    joined = with_job_columns(jobs).join(unique(added), "job_id", "left").join(unique(left), "job_id", "left")
    if costs is None:
        joined = joined.withColumn("_cost", F.lit(0.0))
    else:
        joined = joined.join(unique(costs.groupBy("job_id").agg(F.sum("cost_usd").alias("_cost"))), "job_id", "left")
    worked = F.col("_processed").isNotNull() & F.col("state").isin("queued", "running")
    plus = lambda c, extra: (F.col(c) + F.coalesce(F.when(worked, F.col(extra)), F.lit(0))).cast("bigint")
    remaining = F.coalesce("_left", F.lit(0))
    at = F.lit(now).cast("timestamp_ntz")
    return joined.select(
        "job_id",
        F.when(worked & (remaining == 0), "done").when(worked, "running").otherwise(F.col("state")).alias("state"),
        plus("success_count", "_success").alias("success_count"),
        plus("failure_count", "_failure").alias("failure_count"),
        plus("processed_count", "_processed").alias("processed_count"),
        plus("white_bg_count", "_white").alias("white_bg_count"),
        plus("rembg_count", "_rembg").alias("rembg_count"),
        (F.col("actual_cost_usd") + F.coalesce("_cost", F.lit(0.0))).alias("actual_cost_usd"),
        F.when(worked & (F.col("state") == "queued"), F.coalesce("started_at", at)).otherwise(F.col("started_at")).alias("started_at"),
        F.when(worked & (remaining == 0), at).otherwise(F.col("completed_at")).alias("completed_at"),
        F.coalesce(F.when(worked, F.col("_white")), F.lit(0)).alias("white_bg_added"),
        F.coalesce(F.when(worked, F.col("_rembg")), F.lit(0)).alias("rembg_added"),
        remaining.alias("pending_left"),
    )


@dataclass
class Tick:
    """What one tick changes: whole job rows, processed (job, product) pairs, products in error, alerts."""

    jobs: DataFrame
    processed: DataFrame
    products: DataFrame
    alerts: DataFrame


def tick(
    jobs: DataFrame, job_products: DataFrame, results: DataFrame, products: DataFrame, spend: DataFrame, costs: DataFrame,
    now: dt.datetime, budget: float, address: str = "", limit: int = JOBS_PER_TICK, size: int = CHUNK_SIZE,
) -> Tick:
    """One step of the job loop: budget, pick, chunk, outcome, progress, close.

    ``spend`` (``created_at, cost_usd``) is what the budget counts, ``costs``
    (``job_id, cost_usd``) the usage rows of this tick. A picked job that waits
    becomes running; with nothing pending it is done. A chunk's product without a
    row in ``results`` stays pending and holds its place.

    The at most ``limit`` picked ids come to the driver, so that scans of the
    product and result tables are limited to them; nothing else does.
    """
    jobs = with_job_columns(jobs)
    decided = budget_decision(jobs, spend, now, budget)
    ids = [r["job_id"] for r in pick(decided, limit).select("job_id").collect()]
    mine = F.col("job_id").isin(ids)
    pending = job_products.filter(mine & F.col("pending"))
    work = results.filter(mine).join(chunk(pending, size).select("job_id", "product_id"), ["job_id", "product_id"])
    outcomes = outcome(first_n(work, ["job_id", "product_id"], ["error"], 1), decided.filter(mine), products)
    cost = costs.groupBy("job_id").agg(F.sum("cost_usd").alias("cost_usd"))
    paused = jobs.select("job_id", F.col("state").alias("_before"))
    touched = decided.join(paused, "job_id").join(cost.select("job_id", F.lit(True).alias("_paid")), "job_id", "left")
    touched = touched.filter(mine | F.col("_paid") | (F.col("state") != F.col("_before"))).drop("_before", "_paid", "budget_alert")
    after = progress(touched, pending, outcomes, now, costs)
    at = F.lit(now).cast("timestamp_ntz")
    idle = mine & (F.col("pending_left") == 0) & F.col("state").isin("queued", "running")
    waiting = mine & (F.col("state") == "queued")
    after = after.withColumns({
        "started_at": F.when(waiting, F.coalesce("started_at", at)).otherwise(F.col("started_at")),
        "completed_at": F.when(idle, at).otherwise(F.col("completed_at")),
        "state": F.when(idle, "done").when(waiting, "running").otherwise(F.col("state")),
    })
    kept = [c for c in jobs.columns if c not in after.columns]
    changed = touched.select("job_id", *kept).join(after.drop("white_bg_added", "rembg_added", "pending_left"), "job_id")
    return Tick(
        changed.select(*[F.col(c).cast(jobs.schema[c].dataType) for c in jobs.columns]),
        outcomes.select("job_id", "product_id"),
        outcomes.filter(F.col("product_state").isNotNull()).select("product_id", "product_state", "product_error"),
        alert_rows(jobs, spend, now, budget, address),
    )


def close_empty(jobs: DataFrame, job_products: DataFrame) -> DataFrame:
    """Runnable jobs with nothing pending are done."""
    busy = job_products.filter("pending").select("job_id").distinct().withColumn("_busy", F.lit(True))
    runnable = F.col("state").isin("queued", "running")
    return jobs.join(unique(busy), "job_id", "left").withColumn(
        "state", F.when(runnable & F.col("_busy").isNull(), "done").otherwise(F.col("state"))
    ).drop("_busy")


# ---- spend ----

def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``cost_usd``. Unlisted models have a price of their own; Spark broadcasts the price list if it is small."""
    p_in = F.coalesce("p_in", F.lit(UNLISTED_PRICE[0]))
    p_out = F.coalesce("p_out", F.lit(UNLISTED_PRICE[1]))
    tokens = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    return (
        usage.join(prices, "model", "left")
        .withColumn(
            "cost_usd",
            tokens("input_tokens") * p_in / F.lit(1e6) + tokens("output_tokens") * p_out / F.lit(1e6),
        )
        .drop("p_in", "p_out")
    )


def _month_bounds(now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    start = now.replace(day=1, hour=0, minute=0, second=0, microsecond=0, tzinfo=None)
    return start, (start + dt.timedelta(days=32)).replace(day=1)


def month_to_date(costs: DataFrame, now: dt.datetime) -> DataFrame:
    """One row: spend in the calendar month of ``now``; a plain range, so it reaches the scan."""
    start, end = _month_bounds(now)
    at = F.col("created_at")
    month = costs.filter((at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz")))
    return month.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent_usd"))


def job_spend(costs: DataFrame) -> DataFrame:
    """Actual cost per job, derived from the usage rows."""
    return costs.groupBy("job_id").agg(F.sum("cost_usd").alias("actual_cost_usd"))


def budget_verdict(spent: Column, budget: float) -> Column:
    if not budget:
        return F.lit("none")
    return F.when(spent >= budget, "exhausted").when(spent >= 0.8 * budget, "warning").otherwise("none")


def budget_decision(
    jobs: DataFrame, costs: DataFrame, now: dt.datetime, budget: float = DEFAULTS.monthly_budget_usd
) -> DataFrame:
    """Pause runnable jobs once the month's spend reaches the budget (a scalar subquery)."""
    verdict = month_to_date(costs, now).select(budget_verdict(F.col("spent_usd"), budget)).scalar()
    return jobs.withColumn("budget_alert", verdict).withColumn(
        "state",
        F.when((F.col("budget_alert") == "exhausted") & F.col("state").isin("queued", "running"), "paused").otherwise(
            F.col("state")
        ),
    )


def alert_rows(
    jobs: DataFrame, costs: DataFrame, now: dt.datetime, budget: float, address: str
) -> DataFrame:
    """Zero or one alert. Exhaustion alerts only if it paused a job; no address, no alert."""
    if not address or not budget:
        return month_to_date(costs, now).filter("false").select(
            F.lit("").alias("email_to"), F.lit("").alias("subject"), F.lit("").alias("body")
        )
    runnable = jobs.agg(F.count_if(F.col("state").isin("queued", "running"))).scalar()
    money = lambda c: F.regexp_replace(F.format_number(c, 2), ",", "")
    figures = F.concat(F.lit("($"), money(F.col("spent_usd")), F.lit("/$"), money(F.lit(float(budget))), F.lit(")"))
    decided = month_to_date(costs, now).withColumn("_verdict", budget_verdict(F.col("spent_usd"), budget))
    return decided.filter(
        (F.col("_verdict") == "warning") | ((F.col("_verdict") == "exhausted") & (runnable > 0))
    ).select(
        F.lit(address).alias("email_to"),
        F.when(F.col("_verdict") == "exhausted", F.concat(F.lit("Budget exhausted, jobs paused "), figures))
        .otherwise(F.concat(F.lit("Budget at 80% "), figures)).alias("subject"),
        F.when(F.col("_verdict") == "exhausted", "All running jobs have been paused. Resume them after raising the budget.")
        .otherwise("Monthly spend has reached 80% of the budget.").alias("body"),
    )


# ---- views ----

def log_view(step_log: DataFrame, jobs: DataFrame) -> DataFrame:
    """Log lines of known jobs, newest first within each job."""
    return step_log.join(jobs.select("job_id"), "job_id", "left_semi").orderBy(
        "job_id", F.col("created_at").desc(), F.col("log_id").desc()
    )


def usage_view(costs: DataFrame) -> DataFrame:
    return costs.orderBy(F.col("created_at").desc(), F.col("usage_id").desc())


def list_view(jobs: DataFrame, job_products: DataFrame, costs: DataFrame) -> DataFrame:
    """Jobs newest first with product count and actual spend."""
    return (
        jobs.join(unique(total_count(job_products)), "job_id", "left")
        .join(unique(job_spend(costs)), "job_id", "left")
        .withColumn("total_count", F.coalesce("total_count", F.lit(0)))
        .withColumn("actual_cost_usd", F.coalesce("actual_cost_usd", F.lit(0.0)))
        .orderBy(F.col("created_at").desc(), F.col("job_id").desc())
    )
