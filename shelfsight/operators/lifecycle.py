"""Normalization of main images: change detection, plan, and product state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.operators.candidates import BORDERLINE, studio_verdict
from shelfsight.settings import DEFAULTS, Settings

# fixed values: the settings that a normalized image depends on, in key order
SIGNATURE_KEYS = ("bg_color", "jpeg_quality", "output_format", "padding_percent", "target_canvas_size", "white_threshold")


def _quoted(c: Column) -> Column:
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def settings_signature(values: dict[str, Column]) -> Column:
    """SHA-256 of the settings as JSON with sorted keys, ``", "`` and ``": "`` as separators."""
    parts = []
    for key in SIGNATURE_KEYS:
        value = values[key]
        text = _quoted(value) if key in ("bg_color", "output_format") else value.cast("string")
        parts.append(F.concat(F.lit(f'"{key}": '), text))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


def default_signature(settings: Settings = DEFAULTS) -> Column:
    return settings_signature({k: F.lit(getattr(settings, k)) for k in SIGNATURE_KEYS})


def output_signature(image: Column, signature: Column) -> Column:
    """SHA-256 over the image bytes followed by the settings signature."""
    return F.sha2(F.concat(image.cast("binary"), F.encode(signature, "utf-8")), 256)


def skip_unchanged(products: DataFrame, image: str, signature: Column | None = None) -> DataFrame:
    """Products with an image whose stored signature is missing or no longer matches."""
    current = output_signature(F.col(image), default_signature() if signature is None else signature)
    return products.filter(F.col(image).isNotNull() & ~F.equal_null(F.col("normalization_signature"), current))


def normalize_plan(images: DataFrame, answers: DataFrame) -> DataFrame:
    """What to do with each image: trim only, or remove the background and trim.

    A complex image close to white becomes ``white`` on a studio verdict.
    """
    low, high = BORDERLINE
    close = (F.col("source_state") == "complex") & (F.col("white_percent") >= low) & (F.col("white_percent") < high)
    joined = images.join(answers.select("image_id", "answer"), "image_id", "left")
    state = F.when(close & studio_verdict(F.col("answer")), "white").otherwise(F.col("source_state"))
    return (
        joined.withColumn("borderline", close)
        .withColumn("source_state", state)
        .withColumn("has_white", F.col("has_white") | (F.col("source_state") == "white"))
        .withColumn("action", F.when(F.col("source_state") == "transparent", "trim").otherwise("remove_background_then_trim"))
        .drop("answer")
    )


def normalize_apply_state(products: DataFrame, done: DataFrame) -> DataFrame:
    """Write back finished normalizations: ``product_id, has_white, new_signature``."""
    joined = products.join(done.select("product_id", "has_white", "new_signature"), "product_id", "left")
    finished = F.col("new_signature").isNotNull()
    first_time = finished & (F.col("enrichment_state") == "not_enriched")
    return (
        joined.withColumn("main_image_normalized", F.when(finished, True).otherwise(F.col("main_image_normalized")))
        .withColumn(
            "main_image_already_white_bg", F.when(finished, F.col("has_white")).otherwise(F.col("main_image_already_white_bg"))
        )
        .withColumn("normalization_signature", F.coalesce("new_signature", "normalization_signature"))
        .withColumn("enrichment_state", F.when(first_time, "enriched").otherwise(F.col("enrichment_state")))
        .drop("has_white", "new_signature")
    )


def backup_main(products: DataFrame, image: str, original: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Keep the first original only."""
    if not settings.keep_backup:
        return products
    return products.withColumn(original, F.coalesce(original, image))


def apply_main_state(
    products: DataFrame, outcomes: DataFrame, candidates: DataFrame, outputs: DataFrame, image: str, original: str,
    signature: Column | None = None, settings: Settings = DEFAULTS,
) -> DataFrame:
    """Products after their main candidates were applied.

    ``outcomes`` is what ``apply_main_guard`` says per candidate, ``candidates``
    have ``has_white_background`` and ``confidence``, ``outputs`` the finished image
    per candidate (``candidate_id, output``). A product that got a main has the
    first image it ever had as its backup, the new image with its signature, and is
    normalized and enriched whatever its state was. Where overwriting is on, mains are applied best
    first and the last one stays. An applied candidate without an output, and products without
    one, change nothing.
    """
    order = F.struct(F.coalesce("confidence", F.lit(0.0)), F.col("candidate_id"))
    last = (
        outcomes.filter(F.col("state") == "applied").select("candidate_id", "product_id")
        .join(candidates.select("candidate_id", "has_white_background", "confidence"), "candidate_id")
        .join(outputs.filter(F.col("output").isNotNull()).select("candidate_id", "output"), "candidate_id")
        .groupBy("product_id").agg(F.min_by(F.struct("has_white_background", "output"), order).alias("_main"))
    )
    joined = products.join(last, "product_id", "left")
    got = F.col("_main").isNotNull()
    new = F.col("_main.output")
    own = output_signature(new, default_signature(settings) if signature is None else signature)
    kept = F.coalesce(original, image) if settings.keep_backup else F.col(original)
    changed = {
        original: F.when(got, kept).otherwise(F.col(original)),
        image: F.coalesce(new, image),
        "main_image_normalized": F.when(got, True).otherwise(F.col("main_image_normalized")),
        "main_image_already_white_bg": F.when(got, F.coalesce("_main.has_white_background", F.lit(False))).otherwise(F.col("main_image_already_white_bg")),
        "normalization_signature": F.when(got, own).otherwise(F.col("normalization_signature")),
        "enrichment_state": F.when(got, "enriched").otherwise(F.col("enrichment_state")),
    }
    return joined.withColumns(changed).drop("_main")


def revert_main(products: DataFrame, image: str, original: str) -> DataFrame:
    """Products with a backup, main image restored and both flags cleared."""
    return products.filter(F.col(original).isNotNull()).withColumns(
        {image: F.col(original), "main_image_normalized": F.lit(False), "main_image_already_white_bg": F.lit(False)}
    )


def mark_skipped(products: DataFrame, ids: DataFrame) -> DataFrame:
    skipped = ids.select("product_id", F.lit(True).alias("_skip")).distinct()
    return products.join(skipped, "product_id", "left").withColumn(
        "enrichment_state", F.when(F.col("_skip"), "skipped").otherwise(F.col("enrichment_state"))
    ).drop("_skip")
