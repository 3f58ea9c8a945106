"""Discovery page by page: a product looks at its next page only while no earlier one settled it.

Every listed page goes once through the outbound guard, robots rules, the
fetched pages, stored recipes and classifier answers, all products and places
together, so fetched pages and answers are dealt out once. What a page gives does not
depend on other pages; those behind the first settled one of their product are
dropped afterwards. A product lists at most ``rounds`` pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.functions.binding import with_once
from shelfsight.functions.urls import netloc
from shelfsight.operators.candidates import (
    RECIPE_CONFIDENCE, build_candidates, candidate_stats, fallback_notes, passes_gate, product_state_after_discovery,
    rejections_before_cap,
)
from shelfsight.operators.discovery import MAX_PAGES
from shelfsight.operators.fetching import page_gate, robots_gate, ssrf_filter_resolved
from shelfsight.operators.inventory import render_flag
from shelfsight.operators.joins import many, unique
from shelfsight.operators.recipes import recipe_extract
from shelfsight.session import materialized
from shelfsight.settings import DEFAULTS, Settings
from shelfsight.sources.bodies import classification

SETTLED = ("recipe", "accepted")


def look_at(
    turn: DataFrame, fetched: DataFrame, resolved_ips: DataFrame, rules: DataFrame, recipes: DataFrame, answers: DataFrame,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """``outcome`` of each (product, page) of ``turn``, whatever the product's other pages gave.

    ``refused`` by the outbound guard, disallowed by ``robots``, ``unusable``
    markup, images by a ``recipe``, ``unanswered``, an ``unreadable`` answer,
    ``rejected`` or ``accepted`` by the classifier. An unreadable recipe
    (``recipe_failed``) leaves the page to the classifier. ``fetched`` has one row
    per address, ``answers`` one per product and page. Markup goes to selectors only on
    domains with a recipe, and answers are parsed only where they count.
    """
    asked = robots_gate(ssrf_filter_resolved(turn.select(F.col("page_url").alias("url")).distinct(), resolved_ips), rules, settings.user_agent)
    asked = materialized(asked.select("url", "allowed"), "asked-pages")
    usable = page_gate(fetched.join(unique(asked.filter("allowed")), "url").drop("allowed"))
    read = recipe_extract(render_flag(usable), recipes, settings, every_page=True).select(
        "url", "needs_render", F.col("readable").alias("_readable"), F.col("images").alias("_images"), F.lit(True).alias("_page"))
    on_page = turn.withColumn("url", F.col("page_url"))
    joined = on_page.join(unique(asked), "url", "left").join(many(read), "url", "left").join(
        many(answers.select("product_id", "page_url", "text", F.lit(True).alias("_answered"))), ["product_id", "page_url"], "left")
    by_recipe = F.coalesce(F.size("_images"), F.lit(0)) > 0
    counts = F.col("_page") & ~by_recipe & F.col("_answered")
    told = with_once(joined, "_c", F.when(counts, classification(F.col("text"))))
    outcome = (
        F.when(F.col("allowed").isNull(), "refused").when(~F.col("allowed"), "robots").when(F.col("_page").isNull(), "unusable")
        .when(by_recipe, "recipe").when(F.col("_answered").isNull(), "unanswered").when(F.col("_c.parse_error"), "unreadable")
        .when(passes_gate(F.col("_c")), "accepted").otherwise("rejected")
    )
    classified = F.col("outcome").isin("unanswered", "unreadable", "rejected", "accepted")
    return told.withColumn("outcome", outcome).select(
        "product_id", "page_pos", "page_url", "found_by", "outcome",
        (classified & F.coalesce("needs_render", F.lit(False))).alias("rendered"),
        F.coalesce(F.col("_page") & ~F.col("_readable"), F.lit(False)).alias("recipe_failed"),
        F.when(F.col("outcome") == "recipe", F.col("_images")).when(F.col("outcome") == "accepted", F.col("_c.images")).alias("images"),
        F.when(F.col("outcome") == "recipe", F.lit(RECIPE_CONFIDENCE)).when(F.col("outcome") == "accepted", F.col("_c.product_match_confidence")).alias("match_confidence"),
    )


def discovery_rounds(
    pages: DataFrame, fetched: DataFrame, resolved_ips: DataFrame, rules: DataFrame, recipes: DataFrame, answers: DataFrame,
    settings: Settings = DEFAULTS, rounds: int = MAX_PAGES,
) -> DataFrame:
    """Every page that a product looked at, in order, with its outcome; at most the last one of a product is settled.

    ``pages`` has ``product_id, page_pos, page_url, found_by``, places from 0.
    """
    listed = pages.select("product_id", "page_pos", "page_url", "found_by").filter(F.col("page_pos").between(0, rounds - 1))
    seen = look_at(materialized(listed, "discovered-pages"), fetched, resolved_ips, rules, recipes, answers, settings)
    settled = F.when(F.col("product_id").isNotNull() & F.col("outcome").isin(*SETTLED), F.col("page_pos"))
    last = F.min(settled).over(Window.partitionBy("product_id"))
    return materialized(seen.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col("page_pos") <= F.col("_last"))).drop("_last"), "looked-pages")


def settled_pages(looked: DataFrame) -> DataFrame:
    """The chosen page of every product that has one, as ``build_candidates`` takes it."""
    return looked.filter(F.col("outcome").isin(*SETTLED)).select(
        "product_id", "page_pos", "page_url", "images", "match_confidence", (F.col("outcome") == "recipe").alias("via_recipe"))


def discovery_outcome(looked: DataFrame, products: DataFrame, assets: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per searched product its new state, chosen page and counters."""
    chosen = settled_pages(looked)
    kept = build_candidates(chosen, products, assets, settings)[0]
    states = product_state_after_discovery(products, kept, settings)
    stats = candidate_stats(kept, chosen, products, looked.select("product_id", "page_pos", "rendered"))
    page = chosen.select("product_id", "page_url")
    return states.join(unique(stats), "product_id").join(unique(page), "product_id", "left")


def discovery_log(looked: DataFrame, products: DataFrame, assets: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Log rows of a discovery run: unusable answers, unreadable recipes, pages off the brand's host, rejected images."""
    chosen = settled_pages(looked)
    kept, rejected = build_candidates(chosen, products, assets, settings)
    row = lambda step, level, message: [
        "product_id", F.lit(step).alias("step") if step else "step", F.lit(level).alias("level"), message.alias("message")]
    address = F.col("page_url")
    return (
        looked.filter(F.col("outcome") == "unreadable").select(*row("classify", "error", F.concat(F.lit("Unusable answer for "), address)))
        .unionByName(looked.filter("recipe_failed").select(*row("classify", "warning", F.concat(F.lit("Unreadable recipe for "), netloc(address)))))
        .unionByName(fallback_notes(chosen, products, settings))
        .unionByName(rejections_before_cap(rejected, kept, settings).select(*row("", "warning", F.concat("url", F.lit(": "), "message"))))
    )
