"""From classified pages to stored candidates and product states.

``answers`` has ``product_id, page_pos, page_url, classification`` (see the
answer parser); ``assets`` has what was measured on downloaded images, keyed
by ``url``. Images keep their classifier position ``pos`` throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.functions.text import strip
from shelfsight.functions.urls import host_contains_brand
from shelfsight.functions.vocab import role_priority
from shelfsight.operators.fetching import download_gate
from shelfsight.operators.joins import many, unique
from shelfsight.operators.review import ALREADY_NORMALIZED, NO_IMAGE_DATA
from shelfsight.operators.topk import first_n
from shelfsight.settings import DEFAULTS, Settings

MATCH_CONFIDENCE = 0.5
MIN_BYTES = 4 * 1024
RECIPE_CONFIDENCE = 0.9
AUTO_PIPELINES = ("discover_apply", "full")
BORDERLINE = (70, 90)

# ---- choosing the page ----


def passes_gate(answer: Column) -> Column:
    return answer["page_is_correct_product"] & (answer["product_match_confidence"] >= MATCH_CONFIDENCE)


def classification_gate(answers: DataFrame) -> DataFrame:
    """Answers that accept their page as the product's page."""
    return answers.filter(passes_gate(F.col("classification")))


def choose_page(answers: DataFrame, recipe_hits: DataFrame | None = None) -> DataFrame:
    """First page per product, in discovery order, that a recipe hits or the gate accepts.

    On the same page the recipe is tried first. ``min_by`` keeps one row per
    product and task, so a product with very many pages does not gather them. The rows are sorted for
    that; dealt out first, a task sorts its share, not all that was parsed from its file.
    """
    c = F.col("classification")
    options = classification_gate(answers).select(
        "product_id", "page_pos", "page_url", c["images"].alias("images"),
        c["product_match_confidence"].alias("match_confidence"), F.lit(False).alias("via_recipe"),
    )
    if recipe_hits is not None:
        options = options.unionByName(
            recipe_hits.filter(F.size("images") > 0).select(
                "product_id", "page_pos", "page_url", "images",
                F.lit(RECIPE_CONFIDENCE).alias("match_confidence"), F.lit(True).alias("via_recipe"),
            )
        )
    page = F.struct("page_pos", "page_url", "images", "match_confidence", "via_recipe")
    first = F.min_by(page, F.struct("page_pos", ~F.col("via_recipe")))
    return options.repartition("product_id", "page_pos").groupBy("product_id").agg(first.alias("p")).select("product_id", "p.*")


def has_main_candidate(answers: DataFrame, min_confidence: float = DEFAULTS.min_confidence) -> DataFrame:
    return answers.withColumn(
        "has_main_candidate",
        F.exists(
            F.col("classification")["images"],
            lambda i: F.coalesce((i["role"] == "main") & (i["confidence"] >= min_confidence), F.lit(False)),
        ),
    )


# ---- image gates ----


def chosen_images(chosen: DataFrame) -> DataFrame:
    return chosen.select("product_id", "page_url", "via_recipe", F.posexplode("images").alias("pos", "i")).select(
        "product_id", "page_url", "via_recipe", "pos", "i.url", "i.role", "i.confidence", "i.reasoning"
    )


def candidate_gates(images: DataFrame, products: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Confident images with an address whose role the product collects.

    ``products`` has ``product_id, gallery_enabled, effective_manufacturer``.
    """
    facts = products.select("product_id", "gallery_enabled", F.col("effective_manufacturer").alias("brand"))
    role = F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("uncertain"))
    return (
        images.filter((F.col("confidence") >= settings.min_confidence) & (F.col("url") != ""))
        .withColumn("role", role)
        .join(unique(facts), "product_id")
        .filter((F.col("role") == "main") | F.col("gallery_enabled"))
    )


def brand_host_filter(images: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``on_brand_page`` and ``accepted``: on a brand page, images must be on brand hosts too."""
    named = F.coalesce("brand", F.lit("")) != ""
    on_page = F.lit(settings.strict_brand_url_match) & named & host_contains_brand(F.col("page_url"), F.col("brand"))
    return images.withColumn("on_brand_page", on_page).withColumn(
        "accepted", ~F.col("on_brand_page") | host_contains_brand(F.col("url"), F.col("brand"))
    )


def fallback_notes(chosen: DataFrame, products: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Log rows for products whose chosen page is not on the brand's host."""
    facts = products.select("product_id", F.col("effective_manufacturer").alias("brand"))
    return (
        chosen.join(unique(facts), "product_id")
        .filter(
            F.lit(settings.strict_brand_url_match)
            & (F.col("brand") != "")
            & ~host_contains_brand(F.col("page_url"), F.col("brand"))
        )
        .select(
            "product_id", F.lit("classify").alias("step"), F.lit("info").alias("level"),
            F.concat(F.lit("No brand page for "), "brand", F.lit(", using "), "page_url").alias("message"),
        )
    )


def image_validity(images: DataFrame, assets: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Join images with their downloads and add ``problem``, null for usable ones.

    Images whose download failed drop out silently.
    """
    got = download_gate(assets).drop("status", "content_type")
    width = F.coalesce("width", F.lit(0))
    return images.join(many(got), "url").withColumn(
        "problem",
        F.when(F.col("n_bytes") < MIN_BYTES, "too small")
        .when(~F.col("decodable"), "invalid image")
        .when(
            width < settings.min_image_width,
            F.concat(F.lit("width "), width.cast("string"), F.lit(f" < min {settings.min_image_width}")),
        ),
    )


def studio_verdict(answer: Column) -> Column:
    return F.coalesce(F.upper(strip(answer)).startswith("STUDIO"), F.lit(False))


def main_downgrade(images: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """In strict mode a main without white background needs a studio verdict, else it becomes ``in_use``."""
    if settings.strict_white_main:
        dark_main = (F.col("role") == "main") & ~F.col("has_white")
        studio = studio_verdict(F.col("studio_answer"))
        images = images.withColumns(
            {
                "role": F.when(dark_main & ~studio, "in_use").otherwise(F.col("role")),
                "has_white": F.col("has_white") | (dark_main & studio),
            }
        )
    return images.filter((F.col("role") == "main") | F.col("gallery_enabled"))


def candidate_topn(images: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """First survivors per product in classifier order."""
    return first_n(images, ["product_id"], ["pos"], settings.max_images_per_product, "place")


def candidate_metadata(images: DataFrame) -> DataFrame:
    """Stored size columns: zero sides when undecodable, whole kilobytes, never-null type."""
    side = lambda c: F.when(F.col("decodable"), F.col(c)).otherwise(0)
    return images.select(
        "*",
        side("width").alias("image_width"),
        side("height").alias("image_height"),
        F.floor(F.col("n_bytes") / 1024).cast("int").alias("image_filesize_kb"),
        F.coalesce("mimetype", F.lit("")).alias("image_mimetype"),
    )


def build_candidates(
    chosen: DataFrame, products: DataFrame, assets: DataFrame, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """Kept candidates and, apart, the images that a check rejected."""
    gated = brand_host_filter(candidate_gates(chosen_images(chosen), products, settings), settings)
    checked = image_validity(gated.filter("accepted"), assets, settings)
    kept = candidate_topn(main_downgrade(checked.filter(F.col("problem").isNull()), settings), settings)
    off_brand = gated.filter(~F.col("accepted")).select(
        "product_id", "pos", "url", F.lit("classify").alias("step"), F.lit("off-brand image host on brand page").alias("message")
    )
    unusable = checked.filter(F.col("problem").isNotNull()).select(
        "product_id", "pos", "url", F.lit("download_image").alias("step"), F.col("problem").alias("message")
    )
    return kept, off_brand.unionByName(unusable)


def rejections_before_cap(rejected: DataFrame, kept: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Rejected images that were looked at: those before the product's list was full."""
    full = kept.filter(F.col("place") == settings.max_images_per_product).select("product_id", F.col("pos").alias("_full"))
    return rejected.join(unique(full), "product_id", "left").filter(F.col("_full").isNull() | (F.col("pos") < F.col("_full"))).drop("_full")


# ---- roll-ups ----


def candidate_stats(kept: DataFrame, chosen: DataFrame, products: DataFrame, tries: DataFrame) -> DataFrame:
    """Counters per product of one discovery run, also of products that chose no page.

    ``tries`` has ``product_id, page_pos, rendered`` of the pages a product might
    look at. It looks at them in order, up to the one it chooses; a page that a
    recipe reads is not rendered any more.
    """
    at = chosen.select("product_id", F.col("page_pos").alias("_at"), "via_recipe")
    looked = F.col("_at").isNull() | (F.col("page_pos") < F.col("_at")) | ((F.col("page_pos") == F.col("_at")) & ~F.col("via_recipe"))
    shots = tries.filter("rendered").join(unique(at), "product_id", "left").filter(looked).groupBy("product_id").agg(F.count("*").alias("_shots"))
    counts = kept.groupBy("product_id").agg(
        F.count_if(F.col("has_white")).alias("_white"), F.count_if(~F.col("has_white")).alias("_rembg")
    )
    joined = products.select("product_id").join(unique(at), "product_id", "left").join(unique(counts), "product_id", "left").join(unique(shots), "product_id", "left")
    return joined.select(
        "product_id",
        F.coalesce("_white", F.lit(0)).alias("white_bg"),
        F.coalesce("_rembg", F.lit(0)).alias("rembg"),
        F.when(F.col("via_recipe"), 1).otherwise(0).alias("recipe_hit"),
        F.when(~F.col("via_recipe"), 1).otherwise(0).alias("recipe_miss"),
        F.coalesce("_shots", F.lit(0)).alias("screenshot_used"),
    )


def product_state_after_discovery(products: DataFrame, kept: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """State per searched product: nothing kept, no main in strict mode, or candidates found."""
    counts = kept.groupBy("product_id").agg(F.count_if(F.col("role") == "main").alias("_main"))
    none = F.col("_main").isNull()
    no_main = F.lit(settings.strict_white_main) & (F.col("_main") == 0)
    return products.select("product_id").join(unique(counts), "product_id", "left").select(
        "product_id",
        F.when(none, "no_results").when(no_main, "needs_manual_main").otherwise("candidates_found").alias("enrichment_state"),
    )


def auto_apply(
    candidates: DataFrame, runs: DataFrame, products: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Outcome of applying every confident pending candidate of automatically applied products.

    ``runs`` has ``product_id, pipeline_steps``. Review order decides which
    main comes first; later mains of the product, and all mains of a product
    whose main is already normalized, fail unless overwriting is on. A candidate
    without image data (``has_image_data``, where that column exists) fails and
    takes no place.
    """
    auto = runs.filter(F.col("pipeline_steps").isin(*AUTO_PIPELINES)).select("product_id").distinct()
    threshold = max(settings.min_confidence, settings.auto_apply_confidence)
    due = candidates.filter((F.col("state") == "pending") & (F.col("confidence") >= threshold)).join(
        unique(auto), "product_id", "left_semi"
    )
    if "has_image_data" not in due.columns:
        due = due.withColumn("has_image_data", F.lit(True))
    there = F.coalesce("has_image_data", F.lit(False))
    is_main = F.col("role") == "main"
    order = F.struct(role_priority(F.col("role")), -F.col("confidence"), "candidate_id")
    first = (
        due.filter(is_main & there).groupBy("product_id").agg(F.min_by("candidate_id", order).alias("candidate_id"))
        .select("candidate_id", F.lit(True).alias("_first"))
    )
    joined = due.join(unique(first), "candidate_id", "left").join(
        unique(products.select("product_id", "has_main_image", "main_image_normalized")), "product_id"
    )
    locked = F.col("has_main_image") & F.coalesce("main_image_normalized", F.lit(False))
    blocked = F.lit(not settings.overwrite_existing_main) & is_main & (locked | F.col("_first").isNull())
    return joined.select(
        "candidate_id", "product_id", "role",
        F.when(~there | blocked, "failed").otherwise("applied").alias("state"),
        F.when(~there, F.lit(NO_IMAGE_DATA)).when(blocked, F.lit(ALREADY_NORMALIZED[:255])).alias("rejection_reason"),
    )


def products_enriched(applied: DataFrame) -> DataFrame:
    """Products that received a main image."""
    got_main = (F.col("state") == "applied") & (F.col("role") == "main")
    return applied.groupBy("product_id").agg(F.bool_or(got_main).alias("enriched")).filter("enriched").select("product_id")


def studio_borderline(states: DataFrame, answers: DataFrame) -> DataFrame:
    """Complex images close to white, and their state after the second opinion."""
    low, high = BORDERLINE
    close = states.filter(
        (F.col("source_state") == "complex") & (F.col("white_percent") >= low) & (F.col("white_percent") < high)
    )
    return close.join(answers, "image_id", "left").select(
        "image_id", "white_percent",
        F.when(studio_verdict(F.col("answer")), "white").otherwise("complex").alias("final_state"),
    )
