"""Queries over parsers, settings and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.plans.registry import query
from shelfsight.plans.tables import Tables
from shelfsight.session import shared_folder
from shelfsight.streaming.versions import VersionedTables
from shelfsight.sources import bodies as B
from shelfsight.sources import images as I
from shelfsight.settings import TYPED_DEFAULTS
from shelfsight.sources import parameters, sinks


@query
def scan_images(t: Tables) -> DataFrame:
    return I.image_headers(t("image_blobs"))


@query
def scan_sitemap_urls(t: Tables) -> DataFrame:
    return B.sitemap_urls(t("sitemap_bodies"))


@query
def scan_sitemap_index(t: Tables) -> DataFrame:
    return B.sitemap_children(t("sitemap_bodies"))


@query
def scan_search_brave(t: Tables) -> DataFrame:
    return B.scan_search(t("search_bodies"), "brave")


@query
def scan_search_serpapi(t: Tables) -> DataFrame:
    return B.scan_search(t("search_bodies"), "serpapi")


@query
def scan_search_cse(t: Tables) -> DataFrame:
    return B.scan_search(t("search_bodies"), "google_cse")


@query
def scan_search_ddg(t: Tables) -> DataFrame:
    return B.scan_search(t("search_bodies"), "ddg")


@query
def search_dispatch(t: Tables) -> DataFrame:
    return B.search_dispatch(t("search_bodies"))


@query
def scan_llm_response(t: Tables) -> DataFrame:
    c = F.col("classification")
    return B.scan_answers(t("llm_responses")).select(
        "response_id",
        c["parse_error"].alias("parse_error"),
        c["page_is_correct_product"].alias("page_is_correct_product"),
        c["product_match_confidence"].alias("product_match_confidence"),
        F.size(c["images"]).alias("n_images"),
        F.size(c["rejected"]).alias("n_rejected"),
        F.array_join(F.transform(c["images"], lambda i: F.coalesce(i["role"], F.lit("-"))), ",").alias("roles"),
    )


@query
def settings_typed(t: Tables) -> DataFrame:
    return parameters.typed(t("setting_rows"), TYPED_DEFAULTS)


@query
def settings_save(t: Tables) -> DataFrame:
    changes = t.sql(
        "select c_custkey as scope_id, name, value from (select c_custkey, explode(array('white_threshold', 'padding_percent', 'bg_color')) as name, "
        "cast(c_nationkey + 200 as string) as value from customer where c_mktsegment = 'BUILDING') x"
    )
    return parameters.save(t("setting_rows"), changes)


@query
def sink_candidates(t: Tables) -> DataFrame:
    found = t.sql(
        "select candidate_id, product_id, job_id, role, confidence, source_url, source_page_url, "
        "case when role = 'main' then 'hero shot' end as ai_reasoning, image_width, image_height, "
        "image_width * image_height as image_bytes, case when role <> 'uncertain' then 'image/jpeg' end as image_mimetype, "
        "has_white_background, case when has_white_background then 97.5e0 else 12.5e0 end as background_white_percent, created_at from candidates"
    )
    return sinks.append(sinks.candidate_rows(found), shared_folder(t.spark, "candidates"), ("role",))


@query
def sink_step_log(t: Tables) -> DataFrame:
    rows = sinks.step_rows(t("step_log"))
    back = sinks.append(rows, shared_folder(t.spark, "step-log"), ("level",))
    return back.select("log_id", "job_id", "step", "level", F.length("message").alias("message_length"), F.md5("message").alias("message_md5"))


@query
def sink_usage_log(t: Tables) -> DataFrame:
    calls = t.sql(
        "select usage_id, model, case when duration_ms >= 30 then input_tokens end as input_tokens, "
        "case when error is null then output_tokens end as output_tokens, operation from usage_log"
    )
    back = sinks.append(sinks.usage_rows(calls, t("price_table")), shared_folder(t.spark, "usage-log"))
    return back.withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query
def sink_product_updates(t: Tables) -> DataFrame:
    """Three batches of updates: states, names that are cleared, and late ones that lose; the second arrives twice."""
    applied = "from candidates where state = 'applied' and role = 'main' group by product_id"
    batches = [
        "select product_id, 2 as version, case when count(*) > 5 then array('enrichment_state', 'main_image_normalized') else array('enrichment_state') end as columns, "
        f"cast(null as string) as name, 'enriched' as enrichment_state, true as main_image_normalized {applied}",
        "select product_id, 3 as version, array('name') as columns, cast(null as string) as name, 'lost' as enrichment_state, false as main_image_normalized "
        "from products where product_id % 10 = 3",
        "select product_id, 1 as version, array('name', 'enrichment_state') as columns, 'late' as name, 'late' as enrichment_state, false as main_image_normalized "
        "from products where product_id % 4 = 1",
    ]
    store = VersionedTables(t.spark, shared_folder(t.spark, "products"), {"products": ["product_id"]})
    store.create({"products": sinks.with_versions(t("products").select("product_id", "name", "enrichment_state", "main_image_normalized"))})
    for number in (1, 2, 2, 3):
        sinks.merge_updates(store, "products", t.sql(batches[number - 1]), number)
    return store.current("products").drop("_versions")
