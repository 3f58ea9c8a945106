"""Background and geometry measures over pixels.

``pixels`` has one row per pixel: ``image_id, width, height, x, y, r, g, b, a``.
Border and corner slices overlap, so a pixel counts once per slice that holds
it; the weights below express that without building the slices. Everything
per image is one hash aggregation with map-side combine, so an image that
holds a large share of all pixels costs no single task more than its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.settings import DEFAULTS, Settings


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def _side() -> Column:
    return F.least("height", "width")


def border_thickness() -> Column:
    return F.greatest(F.lit(1), F.floor(_side() * F.lit(0.05)).cast("int"))


def corner_size() -> Column:
    return F.greatest(F.lit(5), F.floor(_side() * F.lit(0.02)).cast("int"))


def ring_weight() -> Column:
    t = border_thickness()
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    return _flag(y < t) + _flag(y >= h - t) + _flag(x < t) + _flag(x >= w - t)


def _corner_columns() -> Column:
    c = corner_size()
    return _flag(F.col("x") < c) + _flag(F.col("x") >= F.col("width") - c)


def top_corner_weight() -> Column:
    return _flag(F.col("y") < corner_size()) * _corner_columns()


def bottom_corner_weight() -> Column:
    return _flag(F.col("y") >= F.col("height") - corner_size()) * _corner_columns()


def bright(threshold: int) -> Column:
    """All three channels at or above the threshold."""
    return (F.col("r") >= threshold) & (F.col("g") >= threshold) & (F.col("b") >= threshold)


def _clamp(value: int, high: int) -> int:
    return max(0, min(high, int(value)))


def _percent(part: str, whole: str) -> Column:
    return F.col(part).cast("double") / F.col(whole).cast("double") * F.lit(100.0)


def border_sums(pixels: DataFrame, white_threshold: int = DEFAULTS.white_threshold) -> DataFrame:
    """Weighted counts per image; pixels outside ring and corners are dropped before the exchange."""
    thr = _clamp(white_threshold, 255)
    weighted = pixels.select(
        "image_id",
        ring_weight().alias("_ring"),
        top_corner_weight().alias("_top"),
        bottom_corner_weight().alias("_bottom"),
        bright(thr).alias("_white"),
        bright(thr - 15).alias("_soft"),
        (F.col("a") < 32).alias("_clear"),
    ).filter("_ring + _top + _bottom > 0")

    def hit(flag: str, weight: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col(weight)).otherwise(0))

    return weighted.groupBy("image_id").agg(
        F.sum("_ring").alias("ring"),
        hit("_clear", "_ring").alias("ring_clear"),
        hit("_white", "_ring").alias("ring_white"),
        F.sum("_top").alias("top"),
        hit("_white", "_top").alias("top_white"),
        F.sum("_bottom").alias("bottom"),
        hit("_soft", "_bottom").alias("bottom_white"),
    )


def state_from_sums(sums: DataFrame, white_bg_min_percent: int = DEFAULTS.white_bg_min_percent) -> DataFrame:
    """Background state from the weighted counts, however they were obtained."""
    least = _clamp(white_bg_min_percent, 100)
    measured = sums.select(
        "image_id",
        _percent("ring_clear", "ring").alias("transparent_percent"),
        _percent("ring_white", "ring").alias("border_white_percent"),
        _percent("top_white", "top").alias("top_white_percent"),
        _percent("bottom_white", "bottom").alias("bottom_white_percent"),
    )
    clear = F.col("transparent_percent") >= 80
    white = (
        (F.col("border_white_percent") >= least)
        & (F.col("top_white_percent") >= 95)
        & (F.col("bottom_white_percent") >= 80)
    )
    return (
        measured.withColumn(
            "source_state", F.when(clear, "transparent").when(white, "white").otherwise("complex")
        )
        .withColumn("has_white", F.col("source_state") == "white")
        .withColumn("white_percent", F.when(clear, F.lit(0.0)).otherwise(F.col("border_white_percent")))
    )


def background_state(
    pixels: DataFrame,
    white_threshold: int = DEFAULTS.white_threshold,
    white_bg_min_percent: int = DEFAULTS.white_bg_min_percent,
) -> DataFrame:
    """Per image: transparent, white or complex, with the percentages behind it."""
    return state_from_sums(border_sums(pixels, white_threshold), white_bg_min_percent)


def bbox_alpha(pixels: DataFrame) -> DataFrame:
    """Tight content box over pixels with any opacity; right and bottom are exclusive, null when empty."""
    inside = F.col("a") != 0
    return pixels.groupBy("image_id").agg(
        F.min(F.when(inside, F.col("x"))).alias("left"),
        F.min(F.when(inside, F.col("y"))).alias("top"),
        (F.max(F.when(inside, F.col("x"))) + 1).alias("right"),
        (F.max(F.when(inside, F.col("y"))) + 1).alias("bottom"),
    )


def bbox_nonwhite(pixels: DataFrame, white_threshold: int = DEFAULTS.white_threshold) -> DataFrame:
    """Content box over pixels with any channel below the threshold, grown by one pixel and clamped."""
    inside = ~bright(white_threshold)
    boxed = pixels.groupBy("image_id").agg(
        F.min(F.when(inside, F.col("x"))).alias("_x0"),
        F.min(F.when(inside, F.col("y"))).alias("_y0"),
        F.max(F.when(inside, F.col("x"))).alias("_x1"),
        F.max(F.when(inside, F.col("y"))).alias("_y1"),
        F.max("width").alias("_w"),
        F.max("height").alias("_h"),
    )
    low = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0), F.col(c) - 1))
    high = lambda c, lim: F.when(F.col(c).isNotNull(), F.least(F.col(lim), F.col(c) + 2))
    return boxed.select(
        "image_id", low("_x0").alias("left"), low("_y0").alias("top"),
        high("_x1", "_w").alias("right"), high("_y1", "_h").alias("bottom"),
    )


def white_to_alpha(pixels: DataFrame, white_threshold: int = DEFAULTS.white_threshold) -> DataFrame:
    """Synthesise opacity: near-white becomes clear, the rest opaque."""
    return pixels.withColumn("a", F.when(bright(white_threshold), 0).otherwise(255))


def canvas_geometry(
    boxes: DataFrame, target_size: int = DEFAULTS.target_canvas_size, padding_percent: int = DEFAULTS.padding_percent
) -> DataFrame:
    """Scale and offset of a ``width x height`` content on the square canvas."""
    if target_size <= 0:
        raise ValueError("target_size must be positive")
    pad = max(0, min(40, int(padding_percent)))
    inner = max(1, int(target_size * (1 - 2 * pad / 100)))
    w, h = F.col("width"), F.col("height")
    scale = F.least(F.lit(float(inner)) / w, F.lit(float(inner)) / h)
    resize = (scale < 1.0) | ((w < inner) & (h < inner))
    side = lambda c: F.when(resize, F.greatest(F.lit(1), F.floor(c * scale).cast("int"))).otherwise(c)
    return (
        boxes.withColumn("inner_size", F.lit(inner))
        .withColumn("scale", scale)
        .withColumn("new_width", side(w))
        .withColumn("new_height", side(h))
        .withColumn("offset_x", F.floor((F.lit(target_size) - F.col("new_width")) / 2).cast("int"))
        .withColumn("offset_y", F.floor((F.lit(target_size) - F.col("new_height")) / 2).cast("int"))
    )


def crop_translate(pixels: DataFrame, boxes: DataFrame, target_size: int) -> DataFrame:
    """Keep pixels inside their box and move them to the canvas centre, without scaling.

    A null box keeps the whole image. Pasting through the own opacity onto a
    clear canvas blends opacity with itself: ``a*a/255``, rounded.
    """
    box = boxes.select("image_id", "left", "top", "right", "bottom")
    joined = pixels.join(box, "image_id")
    left, top = F.coalesce("left", F.lit(0)), F.coalesce("top", F.lit(0))
    right, bottom = F.coalesce("right", "width"), F.coalesce("bottom", "height")
    x, y = F.col("x"), F.col("y")
    off_x = F.floor((F.lit(target_size) - (right - left)) / 2).cast("int")
    off_y = F.floor((F.lit(target_size) - (bottom - top)) / 2).cast("int")
    blended = F.floor((F.col("a") * F.col("a") + 127) / 255).cast("int")
    return (
        joined.filter((x >= left) & (x < right) & (y >= top) & (y < bottom))
        .select(
            "image_id", (x - left + off_x).alias("x"), (y - top + off_y).alias("y"), "r", "g", "b", blended.alias("a")
        )
        .filter((F.col("x").between(0, target_size - 1)) & (F.col("y").between(0, target_size - 1)))
    )


def hex_channel(colour: Column, index: int) -> Column:
    """Channel 0, 1 or 2 of a ``#rgb`` or ``#rrggbb`` text; null or empty means white."""
    digits = F.ltrim(F.coalesce(F.nullif(colour, F.lit("")), F.lit("#FFFFFF")), F.lit("#"))
    pair = F.when(F.length(digits) == 3, F.repeat(F.substring(digits, 1 + index, 1), F.lit(2))).otherwise(
        F.substring(digits, 1 + 2 * index, 2)
    )
    return F.conv(pair, 16, 10).cast("int")


def _over(channel: str, under: Column) -> Column:
    return F.floor((F.col(channel) * F.col("a") + under * (255 - F.col("a")) + 127) / 255).cast("int")


def flatten_on_color(pixels: DataFrame, colour: str | Column = DEFAULTS.bg_color) -> DataFrame:
    """Composite over a plain colour, which may differ per row."""
    c = F.lit(colour) if isinstance(colour, str) else colour
    return pixels.select(
        "image_id", "x", "y", *[_over(ch, hex_channel(c, i)).alias(ch) for i, ch in enumerate("rgb")]
    )


def checkerboard_composite(pixels: DataFrame) -> DataFrame:
    """Composite over a checkerboard so that clear areas show."""
    cell = F.greatest(F.lit(16), F.floor(_side() / 32).cast("int"))
    even = (F.floor(F.col("x") / cell) + F.floor(F.col("y") / cell)) % 2 == 0
    shade = F.when(even, 208).otherwise(240)
    return pixels.select("image_id", "x", "y", *[_over(ch, shade).alias(ch) for ch in "rgb"])


def output_format_choice(images: DataFrame) -> DataFrame:
    """File format a canvas is written in, from the wish, the canvas kind and the source."""
    wish = F.lower(F.coalesce(F.nullif(F.col("output_format"), F.lit("")), F.lit("jpeg")))
    png = (
        F.col("transparent_canvas")
        | (wish == "png")
        | ((wish == "auto") & ~F.col("already_white") & F.col("has_alpha"))
    )
    return images.withColumn("file_format", F.when(png, "PNG").otherwise("JPEG"))


def preview_report(
    pixels: DataFrame,
    white_threshold: int = DEFAULTS.white_threshold,
    white_bg_min_percent: int = DEFAULTS.white_bg_min_percent,
) -> DataFrame:
    """What a settings preview shows per image; corner figures are 0 for transparent sources."""
    clear = F.col("source_state") == "transparent"
    return background_state(pixels, white_threshold, white_bg_min_percent).select(
        "image_id",
        F.col("has_white").alias("detected_white_bg"),
        F.col("white_percent").alias("detected_white_pct"),
        F.when(clear, 0.0).otherwise(F.col("top_white_percent")).alias("detected_top_corner_pct"),
        F.when(clear, 0.0).otherwise(F.col("bottom_white_percent")).alias("detected_bottom_corner_pct"),
        F.when(F.col("has_white"), "clean studio source")
        .otherwise("complex background")
        .alias("notes"),
    )


def regenerate_background(candidates: DataFrame, states: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Refresh the stored background columns of candidates whose image was measured again.

    Joins on ``image_id``; candidates without image data keep their old values.
    """
    fresh = states.select(
        "image_id", F.col("has_white").alias("_white"), F.col("white_percent").alias("_percent")
    )
    return (
        candidates.join(fresh, "image_id", "left")
        .withColumn("has_white_background", F.coalesce("_white", "has_white_background"))
        .withColumn("background_white_percent", F.coalesce("_percent", "background_white_percent"))
        .drop("_white", "_percent")
    )
