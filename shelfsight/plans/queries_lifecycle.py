"""Queries over the normalization lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.operators import lifecycle as L
from shelfsight.operators import raster as R
from shelfsight.operators import review as V
from shelfsight.plans.registry import query
from shelfsight.plans.tables import Tables
from shelfsight.settings import TYPED_DEFAULTS
from shelfsight.sources import parameters


@query
def settings_signature(t: Tables) -> DataFrame:
    """One signature per settings scope."""
    s = parameters.typed(t("setting_rows"), TYPED_DEFAULTS)
    values = {
        "bg_color": F.lit("#FFFFFF"), "jpeg_quality": F.lit(92), "output_format": F.col("output_format"),
        "padding_percent": F.lit(8), "target_canvas_size": F.lit(1920), "white_threshold": F.col("white_threshold"),
    }
    return s.select("scope_id", L.settings_signature(values).alias("signature"))


@query
def output_signature(t: Tables) -> DataFrame:
    return t("products").filter("main_image_text is not null").select(
        "product_id", L.output_signature(F.col("main_image_text"), L.default_signature()).alias("signature")
    )


def with_stored_signature(t: Tables) -> DataFrame:
    """A third of the products carry a current signature, a third a stale one."""
    current = L.output_signature(F.col("main_image_text"), L.default_signature())
    return t("products").withColumn(
        "normalization_signature",
        F.when(F.col("gallery_mode") == "auto", current).when(F.col("gallery_mode") == "yes", F.sha2(F.lit("stale"), 256)),
    )


@query
def skip_unchanged(t: Tables) -> DataFrame:
    return L.skip_unchanged(with_stored_signature(t), "main_image_text").select("product_id", "normalization_signature")


@query
def normalize_plan(t: Tables) -> DataFrame:
    plan = L.normalize_plan(R.background_state(t("pixels")), t("studio_answers"))
    return plan.select("image_id", "source_state", "has_white", "borderline", "action")


@query
def normalize_apply_state(t: Tables) -> DataFrame:
    done = t.sql(
        "select p_partkey as product_id, p_retailprice > 950 as has_white, sha2(p_name, 256) as new_signature from part where p_size between 5 and 30"
    )
    return L.normalize_apply_state(with_stored_signature(t), done).select(
        "product_id", "main_image_normalized", "main_image_already_white_bg", "normalization_signature", "enrichment_state"
    )


@query
def backup_main(t: Tables) -> DataFrame:
    return L.backup_main(t("products"), "main_image_text", "original_image_text").select("product_id", "original_image_text")


@query
def apply_main_state(t: Tables) -> DataFrame:
    """Approved mains are applied; every eleventh image could not be made."""
    candidates = V.approved(t("candidates")).withColumn("has_image_data", F.col("image_width") % 7 != 0)
    outcomes = V.apply_main_guard(candidates, t("products"))
    output = F.when(F.col("product_id") % 11 != 0, F.concat(F.lit("made of "), "source_url"))
    after = L.apply_main_state(
        with_stored_signature(t), outcomes, candidates, candidates.select("candidate_id", output.alias("output")),
        "main_image_text", "original_image_text",
    )
    return after.select("product_id", "main_image_text", "original_image_text", "main_image_normalized", "main_image_already_white_bg",
                        "normalization_signature", "enrichment_state")


@query
def revert_main(t: Tables) -> DataFrame:
    return L.revert_main(t("products"), "main_image_text", "original_image_text").select(
        "product_id", "main_image_text", "main_image_normalized", "main_image_already_white_bg"
    )


@query
def mark_skipped(t: Tables) -> DataFrame:
    ids = t.sql("select product_id from candidates where state = 'rejected' and confidence < 0.6")
    return L.mark_skipped(t("products"), ids).select("product_id", "enrichment_state")


@query
def normalize_catalog(t: Tables) -> DataFrame:
    """The whole normalization of a catalog as one lazy plan."""
    from shelfsight.plans.normalize import normalize_catalog as plan

    return plan(with_stored_signature(t), t("pixels"), t("studio_answers")).withColumn("scale", F.round("scale", 6))
