"""Normalization of a catalog: which images, what to do, and where the content goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.operators import lifecycle as L
from shelfsight.operators import raster as R
from shelfsight.operators import selection as S
from shelfsight.settings import DEFAULTS, Settings


def normalize_catalog(
    products: DataFrame, pixels: DataFrame, answers: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Plan rows for every changed image: state, action, content box and canvas geometry.

    ``pixels.image_id`` is the product id, and ``pixels`` must carry opacity:
    the box is that of the non-clear pixels. Unchanged products are dropped
    first, so their pixels never enter the aggregations.
    """
    due = L.skip_unchanged(S.with_images(products), "main_image_text").select(F.col("product_id").alias("image_id"))
    todo = pixels.join(due, "image_id", "left_semi")
    plan = L.normalize_plan(
        R.background_state(todo, settings.white_threshold, settings.white_bg_min_percent), answers
    )
    whole = todo.groupBy("image_id").agg(F.max("width").alias("_w"), F.max("height").alias("_h"))
    box = R.bbox_alpha(todo).join(whole, "image_id")
    # a fully clear image keeps its whole area
    box = box.select(
        "image_id", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("top", F.lit(0)).alias("top"),
        F.coalesce("right", "_w").alias("right"), F.coalesce("bottom", "_h").alias("bottom"),
    )
    sized = plan.join(box, "image_id").withColumns(
        {"width": F.col("right") - F.col("left"), "height": F.col("bottom") - F.col("top")}
    )
    return R.canvas_geometry(sized, settings.target_canvas_size, settings.padding_percent).select(
        F.col("image_id").alias("product_id"), "source_state", "has_white", "action", "left", "top", "right", "bottom",
        "scale", "new_width", "new_height", "offset_x", "offset_y",
    )
