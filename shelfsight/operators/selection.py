"""Which products or candidates a run works on."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.operators.products import image_count
from shelfsight.session import materialized


def _has_image() -> Column:
    return F.col("has_main_image")


def explicit(products: DataFrame, context_ids: DataFrame, chosen_ids: DataFrame) -> DataFrame:
    """Existing products named by the context or by the explicit choice, each once."""
    wanted = context_ids.select("product_id").union(chosen_ids.select("product_id"))
    return products.join(wanted, "product_id", "left_semi")


def missing_images(products: DataFrame) -> DataFrame:
    return products.filter(~_has_image() & F.col("is_published"))


def single_image(products: DataFrame, gallery_images: DataFrame) -> DataFrame:
    shown = products.filter(F.col("is_published") & _has_image())
    return image_count(shown, gallery_images).filter(F.col("image_count") <= 1)


def category_subtree(categories: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids of the given categories and all their descendants.

    Pointer doubling: every category points to an ancestor and knows whether a
    root lies on the way there, itself included. A round replaces each pointer by
    the pointer of its target, so depth d takes about log2(d) rounds. A pointer
    ends at the top; in a cycle it never does, but once as many steps are covered
    as there are categories, nothing new can be on the way.
    """
    wanted = roots.select(F.col("category_id").alias("_root")).distinct()
    nodes = categories.select("category_id", F.col("parent_id").alias("up")).join(wanted, F.col("category_id") == F.col("_root"), "left")
    nodes = materialized(nodes.select("category_id", "up", F.col("_root").isNotNull().alias("under")), "category-pointers")
    rounds = math.ceil(math.log2(max(2, nodes.count()))) + 1
    for _ in range(rounds):
        if nodes.filter("not under and up is not null").isEmpty():
            break
        ahead = nodes.select(F.col("category_id").alias("_at"), F.col("up").alias("_up"), F.col("under").alias("_under"))
        moved = nodes.join(ahead, F.col("up") == F.col("_at"), "left")
        nodes = materialized(
            moved.select("category_id", F.col("_up").alias("up"), (F.col("under") | F.coalesce("_under", F.lit(False))).alias("under")),
            "category-pointers",
        )
    return nodes.filter("under").select("category_id").distinct()


def by_category(products: DataFrame, categories: DataFrame, roots: DataFrame) -> DataFrame:
    """Products in the subtree of the roots; no roots, no products."""
    return products.join(category_subtree(categories, roots), "category_id", "left_semi")


def all_published(products: DataFrame) -> DataFrame:
    return products.filter("is_published")


def with_images(products: DataFrame) -> DataFrame:
    return products.filter(_has_image())


def not_normalized(products: DataFrame) -> DataFrame:
    return products.filter(_has_image() & ~F.coalesce("main_image_normalized", F.lit(False)))


def category_with_images(products: DataFrame, categories: DataFrame, roots: DataFrame) -> DataFrame:
    return by_category(products.filter(_has_image()), categories, roots)


def selected_with_images(products: DataFrame, context_ids: DataFrame) -> DataFrame:
    return products.filter(_has_image()).join(context_ids.select("product_id"), "product_id", "left_semi")


def unless_forced(products: DataFrame, force: bool = False) -> DataFrame:
    return products if force else products.filter(~F.coalesce("main_image_normalized", F.lit(False)))


def by_skus(products: DataFrame, skus: DataFrame) -> DataFrame:
    """Products whose internal code is in the request list."""
    return products.join(skus.select(F.col("sku").alias("default_code")), "default_code", "left_semi")


def images_by_ids(products: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """All products with an image, or only those in ``ids`` when a list is given."""
    imaged = products.filter(_has_image())
    return imaged if ids is None else imaged.join(ids.select("product_id"), "product_id", "left_semi")


def pending_candidates(candidates: DataFrame, product_ids: DataFrame) -> DataFrame:
    """Pending candidates of the asked products, reduced to the public columns."""
    return (
        candidates.filter(F.col("state") == "pending")
        .join(product_ids.select("product_id"), "product_id", "left_semi")
        .select(
            "candidate_id", "product_id", "source_url", "role", "confidence",
            "has_white_background", "image_width", "image_height",
        )
    )


def job_candidates(candidates: DataFrame, job_ids: DataFrame) -> DataFrame:
    return candidates.join(job_ids.select("job_id"), "job_id", "left_semi")


def product_candidates(candidates: DataFrame, product_ids: DataFrame) -> DataFrame:
    return candidates.join(product_ids.select("product_id"), "product_id", "left_semi")


def cost_estimate(products: DataFrame, pipeline_steps: str, per_product: float = 0.01) -> DataFrame:
    """One row: how many products a run would touch and what discovery would cost."""
    rate = 0.0 if pipeline_steps == "normalize_only" else per_product
    return products.agg(F.count("*").alias("estimated_count")).withColumn(
        "estimated_cost", F.col("estimated_count") * F.lit(rate)
    )


def source_breakdown(
    products: DataFrame, pixels: DataFrame, measure: Callable[[DataFrame], DataFrame], sample_size: int = 20
) -> DataFrame:
    """Scale the background states of the first products to the whole selection.

    ``pixels`` has the product id as ``image_id``; ``measure`` gives ``image_id,
    source_state`` of decodable images. The sample is a top-n over the product
    id, which each task prunes before the exchange; only its pixels, found by a
    broadcast of at most ``sample_size`` ids, are measured.
    """
    sample = products.orderBy("product_id").limit(max(1, sample_size)).select(F.col("product_id").alias("image_id"))
    state = F.col("source_state")
    counts = (
        measure(pixels.join(F.broadcast(sample), "image_id", "left_semi"))
        .agg(
            F.count_if(state == "transparent").alias("_t"),
            F.count_if(state == "white").alias("_w"),
            F.count("*").alias("_n"),
        )
        .withColumn("estimated_count", products.agg(F.count("*")).scalar())
    )
    scaled = lambda c: F.floor(F.col("estimated_count") * F.col(c) / F.greatest(F.lit(1), F.col("_n"))).cast("long")
    return counts.select(
        "estimated_count", scaled("_t").alias("estimated_transparent"), scaled("_w").alias("estimated_white")
    ).withColumn(
        "estimated_complex", F.col("estimated_count") - F.col("estimated_transparent") - F.col("estimated_white")
    )
