"""Queries over URLs, search results, sitemaps and fetch gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.functions import text as X
from shelfsight.functions import urls as U
from shelfsight.operators import discovery as D
from shelfsight.operators import fetching as G
from shelfsight.operators import products as P
from shelfsight.operators.joins import unique
from shelfsight.plans.registry import query
from shelfsight.plans.tables import Tables


def named_products(t: Tables) -> DataFrame:
    """Products with manufacturer and SKU resolved."""
    return P.effective_sku(P.effective_manufacturer(t("products"), t("attribute_lines")))


def _search(t: Tables) -> DataFrame:
    makers = named_products(t).select("product_id", "effective_manufacturer")
    return t("search_results").join(unique(makers), "product_id")


@query
def url_netloc(t: Tables) -> DataFrame:
    u = F.col("url")
    return t("request_urls").select(
        "request_id", U.netloc(u).alias("netloc"), U.hostname(u).alias("hostname"), U.scheme(u).alias("scheme"), U.path(u).alias("path")
    )


@query
def norm_alnum(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.md5(X.norm_alnum(F.col("text"))).alias("norm_md5"), F.length(X.norm_alnum(F.col("text"))).alias("norm_length"))


@query
def host_contains_brand(t: Tables) -> DataFrame:
    rows = t.sql("select product_id, rank, url, p_brand from search_results join part on p_partkey = product_id where url is not null")
    return rows.select("product_id", "rank", "url", U.host_contains_brand(F.col("url"), F.col("p_brand")).alias("on_brand"))


@query
def search_query_text(t: Tables) -> DataFrame:
    return D.search_query_text(named_products(t)).select("product_id", "query_text")


@query
def search_result_filter(t: Tables) -> DataFrame:
    return D.search_result_filter(t("search_results"))


@query
def search_result_rank(t: Tables) -> DataFrame:
    return D.search_result_rank(D.search_result_filter(_search(t))).select("product_id", "host_rank", "rank", "url")


@query
def manufacturer_host_guesses(t: Tables) -> DataFrame:
    return D.host_guesses(named_products(t)).select("product_id", "guess_no", "host")


@query
def sitemap_host_normalize(t: Tables) -> DataFrame:
    u = F.col("url")
    return t("pages").select(
        "page_id", U.sitemap_host(u).alias("host"), U.sitemap_host(u, strict_www=True).alias("strict_host"),
        U.sitemap_host(F.concat(U.netloc(u), F.lit("/"))).alias("bare_host"),
    )


@query
def sitemap_candidates(t: Tables) -> DataFrame:
    hosts = D.host_guesses(named_products(t))
    roots = D.sitemap_addresses(hosts.select("host").distinct()).select("sitemap_url")
    read = D.sitemap_nodes(t("sitemap_store"), roots).select(F.col("root").alias("sitemap_url"))
    return D.sitemap_candidates(hosts, read)


def _roots(t: Tables) -> DataFrame:
    return t.sql("select distinct root as sitemap_url from sitemap_layout")


@query
def sitemap_expand(t: Tables) -> DataFrame:
    return D.sitemap_expand(t("sitemap_store"), _roots(t)).select("root", "sitemap_url", "pos", "loc")


@query
def sku_url_match(t: Tables) -> DataFrame:
    """Every product against the addresses of its brand's site."""
    urls = D.sitemap_expand(t("sitemap_store"), _roots(t)).withColumn("host", U.netloc(F.col("root")))
    wanted = t.sql("select distinct host, case when p_partkey % 50 = 0 then '- _' else concat('Sku ', cast(p_partkey as string)) end as sku from sitemap_layout")
    return D.sku_url_match(urls, wanted)


@query
def discover_pages(t: Tables) -> DataFrame:
    return D.discover_pages(named_products(t), t("sitemap_store"), t("search_results"))


@query
def ssrf_filter_literal(t: Tables) -> DataFrame:
    return G.ssrf_filter_literal(t("request_urls"))


@query
def ssrf_filter_resolved(t: Tables) -> DataFrame:
    return G.ssrf_filter_resolved(t("pages").select("page_id", "url"), t("resolved_ips"))


@query
def robots_gate(t: Tables) -> DataFrame:
    return G.robots_gate(t("pages").select("page_id", "url"), t("robots_rules"), "ProductImageBot/1.0")


@query
def politeness_schedule(t: Tables) -> DataFrame:
    return G.politeness_schedule(t("fetch_requests"), 2.0).withColumn("start_s", F.round("start_s", 4))


@query
def page_gate(t: Tables) -> DataFrame:
    return G.page_gate(t("crawl_pages")).select("page_id", "url")


@query
def page_strip_noise(t: Tables) -> DataFrame:
    return G.page_strip_noise(t("pages")).select("page_id", F.length("html").alias("html_length"), F.md5("html").alias("html_md5"))


@query
def download_gate(t: Tables) -> DataFrame:
    return G.download_gate(t("downloads")).select("candidate_id", "url", "n_bytes", "mimetype")
