"""Per-domain extraction recipes: use, evidence, and bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.functions import markup as M
from shelfsight.functions.binding import with_once
from shelfsight.functions.text import strip
from shelfsight.functions.urls import netloc, resolve
from shelfsight.operators.substrings import FEW, hits_of_few, is_few, substring_hits
from shelfsight.operators.topk import first_n, nth_latest_at_most
from shelfsight.session import materialized
from shelfsight.settings import DEFAULTS, Settings
from shelfsight.sources.bodies import json_object, json_object_text

SALTS = 16
BUILD_THRESHOLD = 5
MAX_FAILURES = 3
EVIDENCE_ROWS = 20
MAIN_CONFIDENCE, GALLERY_CONFIDENCE = 0.9, 0.85

# ---- use ----


def recipe_lookup(pages: DataFrame, recipes: DataFrame, settings: Settings = DEFAULTS, how: str = "inner") -> DataFrame:
    """Pages on a domain with a built, active recipe, with the recipe's columns."""
    ready = recipes.filter(F.lit(settings.recipe_cache) & F.col("recipe_built") & F.col("active"))
    return pages.withColumn("domain", netloc(F.col("url"))).join(ready, "domain", how)


def _excluded(url: Column) -> Column:
    return F.exists(
        F.split(F.coalesce("excluded_url_patterns", F.lit("")), ","),
        lambda p: (strip(p) != "") & F.contains(F.lower(url), F.lower(strip(p))),
    )


def recipe_extract(pages: DataFrame, recipes: DataFrame, settings: Settings = DEFAULTS, every_page: bool = False) -> DataFrame:
    """Per matched page the recipe's ``images`` and whether its selectors were readable.

    ``every_page`` keeps pages without a recipe, with no images; their markup is not looked at.

    The first element of the main selector is the main image; gallery elements
    follow in document order, each address once, none that is excluded.
    """
    matched = recipe_lookup(pages, recipes, settings, "left" if every_page else "inner").withColumn(
        "_html", F.when(F.col("recipe_built"), M.without_noise(F.col("html"))))
    picked = matched.withColumns({
        f"_{part}": M.selected_sources("_html", f"{part}_image_selector", "image_url_attribute") for part in ("main", "gallery")
    })
    usable = lambda sources: F.filter(
        F.transform(F.filter(sources, lambda s: s != ""), lambda s: resolve(F.col("url"), s)), lambda u: ~_excluded(u)
    )
    image = lambda role, score: lambda u: F.struct(
        u.alias("url"), F.lit(role).alias("role"), F.lit(score).alias("confidence"), F.lit(f"recipe {role}").alias("reasoning")
    )
    main = usable(F.slice(F.col("_main.sources"), 1, 1))
    return (
        picked.withColumn("_main_urls", main)
        .withColumn("_gallery_urls", F.array_except(usable(F.col("_gallery.sources")), F.col("_main_urls")))
        .withColumn("readable", F.col("_main.ok") & F.col("_gallery.ok"))
        .withColumn(
            "images",
            F.when(
                F.col("readable"),
                F.concat(
                    F.transform("_main_urls", image("main", MAIN_CONFIDENCE)),
                    F.transform("_gallery_urls", image("angle", GALLERY_CONFIDENCE)),
                ),
            ).otherwise(F.array().cast("array<struct<url: string, role: string, confidence: double, reasoning: string>>")),
        )
        .drop("_html", "_main", "_gallery", "_main_urls", "_gallery_urls")
    )


# ---- bookkeeping ----


def recipe_upsert(recipes: DataFrame, domains: DataFrame) -> DataFrame:
    """Recipes plus one empty row per domain that has none."""
    defaults = {
        "success_count": F.lit(0), "recipe_built": F.lit(False), "consecutive_failures": F.lit(0),
        "active": F.lit(True), "image_url_attribute": F.lit("src"),
    }
    new = domains.select("domain").distinct().join(recipes.select("domain"), "domain", "left_anti")
    filled = new.select(
        *[
            F.col("domain") if c == "domain" else defaults.get(c, F.lit(None)).cast(recipes.schema[c].dataType).alias(c)
            for c in recipes.columns
        ]
    )
    return recipes.unionByName(filled)


def recipe_success_counts(recipes: DataFrame, runs: DataFrame) -> DataFrame:
    """Count each successful run that classification, not a recipe, produced: ``page_url, via_recipe, created_any``."""
    gained = (
        runs.filter(F.col("created_any") & ~F.col("via_recipe"))
        .groupBy(netloc(F.col("page_url")).alias("domain"))
        .agg(F.count("*").alias("_gained"))
    )
    return (
        recipe_upsert(recipes, gained)
        .join(gained, "domain", "left")
        .withColumn("success_count", (F.col("success_count") + F.coalesce("_gained", F.lit(0))).cast("bigint"))
        .drop("_gained")
    )


def recipe_failure_state(recipes: DataFrame, failures: DataFrame) -> DataFrame:
    """Add raised failures (``domain, event_ts``); three in all switch a recipe off for rebuilding."""
    seen = failures.groupBy("domain").agg(F.count("*").alias("_n"), F.max("event_ts").alias("_last"))
    off = F.col("_n").isNotNull() & (F.col("consecutive_failures") >= MAX_FAILURES)
    return (
        recipes.join(seen, "domain", "left")
        .withColumn("consecutive_failures", (F.col("consecutive_failures") + F.coalesce("_n", F.lit(0))).cast("bigint"))
        .withColumn("last_failure", F.col("_last"))
        .withColumn("active", F.col("active") & ~off)
        .withColumn("recipe_built", F.col("recipe_built") & ~off)
        .drop("_n", "_last")
    )


def recipe_success_reset(events: DataFrame) -> DataFrame:
    """Failures since the last success per domain: ``domain, outcome, event_ts, event_id``.

    Events meet the last success of their domain in ``SALTS`` shares, so a
    domain with a large part of all events is no single task's work.
    """
    at = F.struct("event_ts", "event_id")
    success = F.when(F.col("outcome") == "success", at)
    last = events.groupBy("domain").agg(F.max(success).alias("_at")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    since = (F.col("outcome") == "failure") & (F.col("_at").isNull() | (at > F.col("_at")))
    return (
        events.withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int"))
        .join(last, ["domain", "_salt"])
        .groupBy("domain", "_salt")
        .agg(F.count_if(since).alias("_n"), F.max("_at.event_ts").alias("_last"))
        .groupBy("domain")
        .agg(F.sum("_n").alias("consecutive_failures"), F.max("_last").alias("last_validated"))
    )


def recipe_build_due(recipes: DataFrame) -> DataFrame:
    return recipes.filter(~F.col("recipe_built") & F.col("active") & (F.col("success_count") >= BUILD_THRESHOLD))


def _on_domains(accepted: DataFrame, needles: DataFrame, few: int) -> DataFrame:
    """Accepted candidates paired with the domains (``domain, needle``) that their page address contains.

    Of few domains, rows that cannot be among a domain's latest ``EVIDENCE_ROWS`` may be missing.
    """
    if not is_few(needles, few):
        pages = accepted.select("source_page_url", F.lower("source_page_url").alias("_text")).distinct()
        pairs = substring_hits(pages, "_text", needles.select("needle").distinct(), "needle", []).join(needles, "needle")
        return accepted.join(pairs.select("domain", "source_page_url"), "source_page_url")
    texts = accepted.withColumn("_text", F.lower("source_page_url"))
    hits = hits_of_few(texts, "_text", needles, "needle")
    bounds = materialized(nth_latest_at_most(hits, ["domain"], "created_at", "candidate_id", EVIDENCE_ROWS), "evidence-bounds")
    # null, and no limit, where any domain has too few rows
    lowest = bounds.agg(F.when(F.count("*") == F.count("_bound"), F.min("_bound"))).scalar()
    recent = texts.filter(lowest.isNull() | (F.col("created_at") >= lowest))
    return (
        hits_of_few(recent, "_text", needles, "needle").join(F.broadcast(bounds), "domain")
        .filter(F.col("_bound").isNull() | (F.col("created_at") >= F.col("_bound")))
        .drop("_text", "needle", "_bound")
    )


def recipe_evidence(domains: DataFrame, candidates: DataFrame, few: int = FEW) -> DataFrame:
    """Example pages per domain for building a recipe.

    The latest 20 accepted candidates whose page address contains the domain,
    in any letter case; domains need five rows on five pages, and their five
    most recent pages are shown. Up to ``few`` domains are copied to the candidates,
    and only those at least as late as some 20 of a domain are sorted; for more domains
    containment is an equi-join on substrings of the distinct page addresses.
    Behind the limit of 20 every group is small.
    """
    accepted = candidates.filter(F.col("state").isin("approved", "applied")).select(
        "candidate_id", "source_page_url", "source_url", "role", "created_at"
    )
    needles = domains.filter(F.col("domain") != "").select("domain", F.lower("domain").alias("needle")).distinct()
    latest = first_n(
        _on_domains(accepted, needles, few), ["domain"], [F.col("created_at").desc(), "candidate_id"], EVIDENCE_ROWS, "place"
    )
    by_page = latest.groupBy("domain", "source_page_url").agg(
        F.min("place").alias("_first"),
        F.count("*").alias("n_images"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", F.col("source_url").alias("url"), "role"))),
            lambda i: F.struct(i["url"].alias("url"), i["role"].alias("role")),
        ).alias("_images"),
    )
    of_domain = Window.partitionBy("domain")
    return (
        by_page.withColumn("_rows", F.sum("n_images").over(of_domain))
        .withColumn("_pages", F.count("*").over(of_domain))
        .withColumn("page_no", F.row_number().over(of_domain.orderBy("_first")))
        .filter(
            (F.col("_rows") >= BUILD_THRESHOLD) & (F.col("_pages") >= BUILD_THRESHOLD) & (F.col("page_no") <= BUILD_THRESHOLD)
        )
        .select("domain", "page_no", F.col("source_page_url").alias("page_url"), "n_images", F.to_json("_images").alias("images_json"))
    )


def recipe_ingest(answers: DataFrame, built_at: Column | None = None) -> DataFrame:
    """Recipe columns from builder answers (``domain, text``); a recipe is built if it has any selector.

    Answers that are not one object with double quotes are left out. The answer's object is kept as ``raw_recipe_json``; ``last_built`` is
    ``built_at``, by default the time of the query.
    """
    fields = ("main_image_selector", "gallery_image_selector", "image_url_attribute", "excluded_url_patterns", "notes")
    schema = ", ".join(f"{f}: STRING" for f in fields)
    named = with_once(answers.select("domain", "text"), "_object", json_object_text(F.col("text")))
    raw = with_once(named, "r", json_object(F.col("_object"), schema))
    built = F.current_timestamp() if built_at is None else built_at
    text = lambda f, default="": F.coalesce(F.nullif(F.col(f"r.{f}"), F.lit("")), F.lit(default)).alias(f)
    return (
        raw.filter(F.col("r").isNotNull())
        .select(
            "domain", text("main_image_selector"), text("gallery_image_selector"), text("image_url_attribute", "src"),
            text("excluded_url_patterns"), text("notes"), F.col("_object").alias("raw_recipe_json"), built.alias("last_built"),
        )
        .withColumn("recipe_built", (F.col("main_image_selector") != "") | (F.col("gallery_image_selector") != ""))
    )


def recipe_order(recipes: DataFrame) -> DataFrame:
    """Most successful first, then the latest written; equal ones by domain."""
    return recipes.orderBy(F.col("success_count").desc(), F.col("written_at").desc_nulls_last(), F.col("domain"))
