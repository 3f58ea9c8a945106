"""Computed product columns and candidate ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.functions.text import first_filled, strip
from shelfsight.functions.vocab import role_priority, role_sequence
from shelfsight.operators.joins import unique


def effective_manufacturer(
    products: DataFrame, attribute_lines: DataFrame, brand_attribute: str = "Brand"
) -> DataFrame:
    """Add ``effective_manufacturer``: override, else brand attribute, else first word of the name.

    The brand is the first value of the first matching attribute line that has
    values, taken with ``min_by`` so the shuffle carries one row per product.
    A blank-only override counts as set and yields the empty string.
    """
    out = products
    if brand_attribute and brand_attribute.strip():
        brands = (
            attribute_lines.filter(
                (F.lower(strip(F.coalesce("attribute_name", F.lit("")))) == brand_attribute.strip().lower())
                & F.col("value_name").isNotNull()
            )
            .groupBy("product_id")
            .agg(F.min_by("value_name", F.struct("line_no", "value_no")).alias("_brand"))
        )
        out = out.join(unique(brands), "product_id", "left")
    else:
        out = out.withColumn("_brand", F.lit(None).cast("string"))
    first_word = F.regexp_extract(strip(F.coalesce("name", F.lit(""))), r"^\S+", 0)
    return out.withColumn(
        "effective_manufacturer",
        F.when(F.col("manufacturer_override") != "", strip(F.col("manufacturer_override")))
        .when(F.col("_brand").isNotNull(), strip(F.col("_brand")))
        .otherwise(first_word),
    ).drop("_brand")


def effective_sku(products: DataFrame) -> DataFrame:
    return products.withColumn(
        "effective_sku", strip(first_filled(F.col("manufacturer_sku"), F.col("default_code")))
    )


def gallery_enabled(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Per-product choice, or the category's flag when the choice is ``auto``."""
    flags = categories.select("category_id", F.col("enable_gallery").alias("_flag"))
    return (
        products.join(flags, "category_id", "left")
        .withColumn(
            "gallery_enabled",
            F.when(F.col("gallery_mode") == "yes", True)
            .when(F.col("gallery_mode") == "no", False)
            .otherwise(F.coalesce("_flag", F.lit(False))),
        )
        .drop("_flag")
    )


def candidate_counts(products: DataFrame, candidates: DataFrame) -> DataFrame:
    counts = candidates.groupBy("product_id").agg(
        F.count("*").alias("_all"), F.count_if(F.col("state") == "pending").alias("_pending")
    )
    return products.join(unique(counts), "product_id", "left").select(
        products["*"],
        F.coalesce("_all", F.lit(0)).alias("candidate_count"),
        F.coalesce("_pending", F.lit(0)).alias("pending_candidate_count"),
    )


def image_count(products: DataFrame, gallery_images: DataFrame) -> DataFrame:
    counts = gallery_images.groupBy("product_id").agg(F.count("*").alias("_gallery"))
    return products.join(unique(counts), "product_id", "left").select(
        products["*"],
        (F.coalesce("_gallery", F.lit(0)) + F.when(F.col("has_main_image"), 1).otherwise(0)).alias("image_count"),
    )


def with_role_priority(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("role_priority", role_priority(F.coalesce("role", F.lit("uncertain"))))


def with_role_sequence(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("role_sequence", role_sequence(F.col("role")))


def candidate_order(candidates: DataFrame) -> DataFrame:
    """Global review order; the id breaks ties, so range partitioning can split any hot product."""
    return with_role_priority(candidates).orderBy(
        "product_id", "role_priority", F.col("confidence").desc(), "candidate_id"
    )


def candidate_board(candidates: DataFrame) -> DataFrame:
    """Column heads of the review board: size, best score and state counts per product."""
    state = F.col("state")
    return candidates.groupBy("product_id").agg(
        F.count("*").alias("n_candidates"),
        F.count_if(state == "pending").alias("n_pending"),
        F.count_if(state == "approved").alias("n_approved"),
        F.count_if(state == "applied").alias("n_applied"),
        F.count_if(state == "rejected").alias("n_rejected"),
        F.count_if(state == "failed").alias("n_failed"),
        F.count_if(F.col("role") == "main").alias("n_main"),
        F.max("confidence").alias("best_confidence"),
    )
