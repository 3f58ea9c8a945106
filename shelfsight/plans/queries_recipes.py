"""Queries over extraction recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.operators import fetching as G
from shelfsight.operators import recipes as C
from shelfsight.plans.registry import query
from shelfsight.plans.tables import Tables


@query
def recipe_lookup(t: Tables) -> DataFrame:
    return C.recipe_lookup(t("crawl_pages"), t("recipes")).select("page_id", "url", "domain", "main_image_selector")


@query
def recipe_extract(t: Tables) -> DataFrame:
    found = C.recipe_extract(G.page_gate(t("crawl_pages")), t("recipes"))
    return found.select("page_id", F.posexplode("images").alias("pos", "i")).select(
        "page_id", "pos", "i.url", "i.role", "i.confidence"
    )


@query
def recipe_upsert(t: Tables) -> DataFrame:
    return C.recipe_upsert(t("recipes").drop("written_at"), t("learned_domains"))


@query
def recipe_success_counts(t: Tables) -> DataFrame:
    known = t.sql(
        "select domain, cast(0 as int) as success_count, false as recipe_built, cast(0 as int) as consecutive_failures, true as active from learned_domains"
    )
    return C.recipe_success_counts(known, t("product_runs")).select("domain", "success_count")


@query
def recipe_failure_state(t: Tables) -> DataFrame:
    known = t.sql(
        "select concat('d', cast(c_custkey as string), '.example.com') as domain, cast(c_nationkey % 4 as int) as consecutive_failures, "
        "c_nationkey > 3 as recipe_built, c_acctbal > 0 as active from customer"
    )
    failures = t("recipe_events").filter("outcome = 'failure'")
    return C.recipe_failure_state(known, failures)


@query
def recipe_success_reset(t: Tables) -> DataFrame:
    return C.recipe_success_reset(t("recipe_events"))


@query
def recipe_build_due(t: Tables) -> DataFrame:
    return C.recipe_build_due(t("recipes")).select("domain", "success_count")


@query
def recipe_evidence(t: Tables) -> DataFrame:
    domains = t.sql("select domain from learned_domains union all select 'BRAND1' union all select 'product/77'")
    return C.recipe_evidence(domains, t("candidates"))


@query
def recipe_ingest(t: Tables) -> DataFrame:
    return C.recipe_ingest(t("recipe_answers"), F.lit("2024-03-01 12:00:00").cast("timestamp_ntz"))


@query
def recipe_order(t: Tables) -> DataFrame:
    return C.recipe_order(t("recipes")).select("domain", "success_count", F.date_format("written_at", "yyyy-MM-dd").alias("written_on"))
