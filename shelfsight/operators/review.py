"""Review queue: bulk approval, state changes, applying accepted candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.functions.vocab import role_sequence
from shelfsight.settings import DEFAULTS, Settings

# fixed values: reasons stored with failed candidates
ALREADY_NORMALIZED = "Main image already normalized — enable overwrite_existing_main to replace"
NO_IMAGE_DATA = "Candidate has no image data"


def _role_matches(role_filter: str) -> Column:
    if role_filter == "main":
        return F.col("role") == "main"
    if role_filter == "gallery":
        return F.coalesce(F.col("role") != "main", F.lit(True))
    return F.lit(True)


def bulk_approve(
    candidates: DataFrame, threshold: float = 0.85, role_filter: str = "main", job_id: int | None = None
) -> DataFrame:
    """All candidates with ``state`` moved to approved where the filter holds, flagged ``newly_approved``."""
    hit = (F.col("state") == "pending") & (F.col("confidence") >= threshold) & _role_matches(role_filter)
    if job_id is not None:
        hit = hit & (F.col("job_id") == job_id)
    hit = F.coalesce(hit, F.lit(False))
    return candidates.withColumn("newly_approved", hit).withColumn(
        "state", F.when(F.col("newly_approved"), F.lit("approved")).otherwise(F.col("state"))
    )


def approved(candidates: DataFrame, job_id: int | None = None) -> DataFrame:
    """Candidates waiting to be applied."""
    waiting = candidates.filter(F.col("state") == "approved")
    return waiting if job_id is None else waiting.filter(F.col("job_id") == job_id)


def transition(candidates: DataFrame, actions: DataFrame) -> DataFrame:
    """Apply one reviewer action per candidate: ``candidate_id, action, error``.

    ``apply`` with an error text fails the candidate and keeps the first 255
    characters as the reason. As in the model, no action checks the old state.
    """
    joined = candidates.join(actions.select("candidate_id", "action", "error"), "candidate_id", "left")
    failed = (F.col("action") == "apply") & F.col("error").isNotNull()
    return joined.withColumn(
        "state",
        F.when(F.col("action") == "approve", "approved")
        .when(F.col("action") == "reject", "rejected")
        .when(failed, "failed")
        .when(F.col("action") == "apply", "applied")
        .otherwise(F.col("state")),
    ).withColumn("rejection_reason", F.when(failed, F.substring("error", 1, 255)))


def apply_main_guard(candidates: DataFrame, products: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Outcome of applying main candidates, best confidence first: applied, or failed with a reason.

    A candidate without image data (``has_image_data``, where that column exists)
    fails and takes no place. Without overwrite, a product takes at most one
    main: the best of the others, and only if its current main is absent or not
    yet normalized. The best per product comes from ``min_by`` (one row per product and task before the shuffle) and
    is joined back on the candidate id, which no product can skew.
    """
    mains = candidates.filter(F.col("role") == "main")
    if "has_image_data" not in mains.columns:
        mains = mains.withColumn("has_image_data", F.lit(True))
    there = F.coalesce("has_image_data", F.lit(False))
    state = products.select("product_id", "has_main_image", "main_image_normalized")
    joined = mains.join(state, "product_id")
    if settings.overwrite_existing_main:
        blocked = F.lit(False)
    else:
        best = F.struct(-F.coalesce("confidence", F.lit(0.0)), F.col("candidate_id"))
        first = mains.filter(there).groupBy("product_id").agg(
            F.min_by("candidate_id", best).alias("candidate_id")
        ).select("candidate_id", F.lit(True).alias("_first"))
        joined = joined.join(first, "candidate_id", "left")
        locked = F.col("has_main_image") & F.coalesce("main_image_normalized", F.lit(False))
        blocked = locked | F.col("_first").isNull()
    return joined.select(
        "candidate_id",
        "product_id",
        F.when(~there | blocked, "failed").otherwise("applied").alias("state"),
        F.when(~there, F.lit(NO_IMAGE_DATA)).when(blocked, F.lit(ALREADY_NORMALIZED)).alias("rejection_reason"),
    )


def apply_gallery(candidates: DataFrame, products: DataFrame) -> DataFrame:
    """Gallery rows for applied non-main candidates; the original bytes are kept as they are."""
    names = products.select("product_id", F.col("name").alias("_name"))
    return (
        candidates.filter(F.coalesce(F.col("role") != "main", F.lit(True)))
        .join(names, "product_id")
        .select(
            "candidate_id",
            "product_id",
            F.concat("_name", F.lit(" - "), "role").alias("name"),
            role_sequence(F.col("role")).alias("sequence"),
            F.col("source_url").alias("image_ref"),
        )
    )
