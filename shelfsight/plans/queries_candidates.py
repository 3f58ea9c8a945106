"""Queries over page images, classification and candidate building."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.functions import urls as U
from shelfsight.operators import candidates as C
from shelfsight.operators import discovery as D
from shelfsight.operators import inventory as N
from shelfsight.operators import products as P
from shelfsight.operators import raster as R
from shelfsight.operators import rounds as W
from shelfsight.plans.queries_discovery import named_products
from shelfsight.plans.registry import query
from shelfsight.plans.tables import Tables
from shelfsight.session import materialized
from shelfsight.sources.bodies import scan_answers

# ---- page images ----


@query
def img_inventory(t: Tables) -> DataFrame:
    return N.img_inventory(t("crawl_pages"), "page_id")


@query
def url_resolve(t: Tables) -> DataFrame:
    refs = t.sql(
        "select page_id, url, ref from (select page_id, url, explode(array('https://cdn.example.com/a/../b.png', '//cdn.example.com/x', '/img/./a/../b.jpg', "
        "'../up/../../c.png?q=../x#f', 'd//e;p=1/f.jpg;v=2', '?only=query', '#frag', '', '..', 'data:image/png;base64,AA', '/')) as ref from pages) r"
    )
    return refs.select("page_id", "ref", U.resolve(F.col("url"), F.col("ref")).alias("resolved"))


@query
def img_dedupe(t: Tables) -> DataFrame:
    return N.img_dedupe(t("crawl_pages"), "page_id")


@query
def img_junk_filter(t: Tables) -> DataFrame:
    return N.img_junk_filter(t("crawl_pages"), "page_id")


@query
def img_cap(t: Tables) -> DataFrame:
    """Pages whose gallery repeats with 40 more addresses, so that the cap of 60 binds on none or some."""
    wide = t.sql(
        "select page_id, url, concat(html, array_join(transform(sequence(1, cast(page_id % 90 as int) + 1), i -> concat('<img src=\"/wide/', cast(i as string), '.jpg\">')), '')) as html from crawl_pages"
    )
    return N.img_cap(wide, "page_id").select("page_id", "pos", "url")


@query
def img_context(t: Tables) -> DataFrame:
    return N.with_images(t("crawl_pages")).select("page_id", F.inline("images")).select("page_id", "pos", "url", "context")


@query
def render_flag(t: Tables) -> DataFrame:
    return N.render_flag(t("crawl_pages")).select("page_id", "n_img", "needs_render")


@query
def prompt_rows(t: Tables) -> DataFrame:
    """Each page is asked about for the product with the same number."""
    pages = N.with_images(t("crawl_pages")).select("page_id", F.col("url").alias("page_url"), "images")
    names = t("categories").select("category_id", F.col("name").alias("category_name"))
    products = named_products(t).join(names, "category_id", "left")
    requests = products.join(pages, products["product_id"] == pages["page_id"])
    return N.prompt_rows(requests).select("product_id", "page_url", "n_images", "request_text", "answer")


# ---- classification and candidates ----


def _answers(t: Tables) -> DataFrame:
    return scan_answers(t("llm_responses"))


def _recipe_hits(t: Tables) -> DataFrame:
    image = lambda url, role, score: F.struct(
        F.col(url).alias("url"), F.lit(role).alias("role"), F.lit(score).alias("confidence"), F.lit("recipe").alias("reasoning")
    )
    both = F.array(image("main_url", "main", 0.9), image("gallery_url", "angle", 0.85))
    return t("recipe_hits").select("product_id", "page_pos", "page_url", F.filter(both, lambda i: i["url"].isNotNull()).alias("images"))


def _chosen(t: Tables) -> DataFrame:
    return C.choose_page(_answers(t), _recipe_hits(t))


def _flags(t: Tables) -> DataFrame:
    return P.gallery_enabled(named_products(t), t("categories")).select("product_id", "gallery_enabled", "effective_manufacturer")


def _kept(t: Tables) -> DataFrame:
    return C.build_candidates(_chosen(t), _flags(t), t("asset_facts"))[0]


@query
def classification_gate(t: Tables) -> DataFrame:
    return C.classification_gate(_answers(t)).select("response_id", "product_id", "page_pos")


@query
def choose_page(t: Tables) -> DataFrame:
    return _chosen(t).select("product_id", "page_pos", "page_url", "match_confidence", "via_recipe", F.size("images").alias("n_images"))


@query
def has_main_candidate(t: Tables) -> DataFrame:
    return C.has_main_candidate(_answers(t)).select("response_id", "has_main_candidate")


@query
def candidate_gates(t: Tables) -> DataFrame:
    return C.candidate_gates(C.chosen_images(_chosen(t)), _flags(t)).select("product_id", "pos", "url", "role", "confidence")


@query
def brand_host_filter(t: Tables) -> DataFrame:
    images = C.candidate_gates(C.chosen_images(_chosen(t)), _flags(t))
    return C.brand_host_filter(images).select("product_id", "pos", "url", "on_brand_page", "accepted")


@query
def brand_fallback_notes(t: Tables) -> DataFrame:
    return C.fallback_notes(_chosen(t), _flags(t))


@query
def image_validity(t: Tables) -> DataFrame:
    images = C.brand_host_filter(C.candidate_gates(C.chosen_images(_chosen(t)), _flags(t))).filter("accepted")
    return C.image_validity(images, t("asset_facts")).select("product_id", "pos", "url", "n_bytes", "problem")


@query
def main_downgrade(t: Tables) -> DataFrame:
    images = C.brand_host_filter(C.candidate_gates(C.chosen_images(_chosen(t)), _flags(t))).filter("accepted")
    usable = C.image_validity(images, t("asset_facts")).filter("problem is null")
    return C.main_downgrade(usable).select("product_id", "pos", "url", "role", "has_white")


@query
def candidate_topn(t: Tables) -> DataFrame:
    return _kept(t).select("product_id", "pos", "place", "url", "role", "confidence")


@query
def candidate_rejections(t: Tables) -> DataFrame:
    kept, rejected = C.build_candidates(_chosen(t), _flags(t), t("asset_facts"))
    return C.rejections_before_cap(rejected, kept).select("product_id", "pos", "url", "step", "message")


@query
def candidate_metadata(t: Tables) -> DataFrame:
    return C.candidate_metadata(_kept(t)).select(
        "product_id", "pos", "image_width", "image_height", "image_filesize_kb", "image_mimetype"
    )


@query
def candidate_stats(t: Tables) -> DataFrame:
    """Pages on even places had to be rendered."""
    tries = _answers(t).select("product_id", "page_pos", (F.col("page_pos") % 2 == 0).alias("rendered"))
    return C.candidate_stats(_kept(t), _chosen(t), t("products"), tries)


@query
def product_state_after_discovery(t: Tables) -> DataFrame:
    return C.product_state_after_discovery(t("products"), _kept(t))


def _runs(t: Tables) -> DataFrame:
    return t.sql("select product_id, pipeline_steps from job_products join jobs on jobs.job_id = job_products.job_id where state = 'running' and pending")


def _with_images(t: Tables) -> DataFrame:
    """Every seventh candidate lost its image."""
    return t("candidates").withColumn("has_image_data", F.col("image_width") % 7 != 0)


@query
def auto_apply(t: Tables) -> DataFrame:
    return C.auto_apply(_with_images(t), _runs(t), t("products"))


@query
def auto_apply_products(t: Tables) -> DataFrame:
    return C.products_enriched(C.auto_apply(_with_images(t), _runs(t), t("products")))


@query
def studio_borderline(t: Tables) -> DataFrame:
    return C.studio_borderline(R.background_state(t("pixels")), t("studio_answers")).withColumn(
        "white_percent", F.round("white_percent", 6)
    )


# ---- one plan from products to states ----


def _looked(t: Tables) -> DataFrame:
    pages = D.discover_pages(named_products(t), t("sitemap_store"), t("search_results"))
    made = t.storing("page_addresses")
    # one row per domain: read from storage, Spark knows how few they are
    domains = made.storing("page_domains")
    few = [materialized(domains(name), name) for name in ("site_ips", "site_rules", "page_recipes")]
    return W.discovery_rounds(pages, made("page_fetches"), *few, made("page_answers"))


@query
def discovery_rounds(t: Tables) -> DataFrame:
    return _looked(t).select(
        "product_id", "page_pos", "page_url", "outcome", "rendered", "recipe_failed", F.size(F.coalesce("images", F.array())).alias("n_images"))


@query
def discovery_outcome(t: Tables) -> DataFrame:
    return W.discovery_outcome(_looked(t), _flags(t), t("asset_facts"))


@query
def discovery_log(t: Tables) -> DataFrame:
    return W.discovery_log(_looked(t), _flags(t), t("asset_facts"))
