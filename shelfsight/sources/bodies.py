"""Parsers for response bodies: sitemaps, search results, classifier answers."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsight.functions.binding import let, with_once
from shelfsight.functions.text import strip, unescape_html

MAX_URLS_PER_SITEMAP = 50_000

# ---- sitemaps ----


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per sitemap file; a file that begins like gzip is inflated, whatever its name.

    One that cannot be inflated, or whose name ends in ``.gz`` without being gzip, has no body.
    """
    files = spark.read.format("binaryFile").load(path).select(F.input_file_name().alias("sitemap_url"), "content")
    packed = F.hex(F.substring("content", 1, 2)) == "1F8B"
    plain = F.when(~packed & ~F.col("sitemap_url").endswith(".gz"), F.decode("content", "UTF-8"))
    return files.select("sitemap_url", F.coalesce(plain, _inflated(F.when(packed, F.col("content")))).alias("body"))


@F.pandas_udf(T.StringType())
def _inflated(content: pd.Series) -> pd.Series:
    def inflate(data: bytes | None) -> str | None:
        try:
            return None if data is None else gzip.decompress(data).decode("utf-8", "replace")
        except (OSError, EOFError, zlib.error):
            return None

    return content.map(inflate)


def _locations(body: Column, element: str) -> Column:
    """Trimmed, non-blank ``loc`` texts of the given child element; null where the XML does not parse."""
    schema = f"{element} ARRAY<STRUCT<loc: STRING>>, _corrupt_record STRING"
    parsed = F.from_xml(body, schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    texts = F.transform(parsed[element], lambda e: strip(F.coalesce(e["loc"], F.lit(""))))
    return F.when(parsed["_corrupt_record"].isNull(), F.filter(texts, lambda s: s != ""))


def _is_index(body: Column) -> Column:
    root = F.regexp_extract(body, r"(?s)^\s*(?:<[?!][^>]*>\s*)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    return F.lower(root).endswith("sitemapindex")


def sitemap_urls(files: DataFrame, max_urls: int = MAX_URLS_PER_SITEMAP) -> DataFrame:
    """Page addresses of url sets, numbered in document order; each file is parsed where it is read."""
    locs = F.slice(F.coalesce(_locations(F.col("body"), "url"), F.array().cast("array<string>")), 1, max_urls)
    return files.filter(~_is_index(F.col("body"))).select("sitemap_url", F.posexplode(locs).alias("pos", "loc"))


def sitemap_children(files: DataFrame) -> DataFrame:
    """Child sitemaps of sitemap indexes, numbered in document order."""
    locs = F.coalesce(_locations(F.col("body"), "sitemap"), F.array().cast("array<string>"))
    return files.filter(_is_index(F.col("body"))).select("sitemap_url", F.posexplode(locs).alias("pos", "loc"))


def sitemap_store(files: DataFrame) -> DataFrame:
    """Both kinds in the layout the discovery operators read."""
    urls = sitemap_urls(files).withColumn("kind", F.lit("urlset"))
    return urls.unionByName(sitemap_children(files).withColumn("kind", F.lit("index")))


# ---- search results ----

_RESULT = "STRUCT<url: STRING, title: STRING, snippet: STRING>"


def _json_results(body: Column, schema: str, field: str, url: str, snippet: str) -> Column:
    items = F.from_json(body, schema)
    for step in field.split("."):
        items = items[step]
    return F.transform(
        items,
        lambda r: F.struct(
            r[url].alias("url"),
            F.coalesce(r["title"], F.lit("")).alias("title"),
            F.coalesce(r[snippet], F.lit("")).alias("snippet"),
        ),
    ).cast(f"ARRAY<{_RESULT}>")


def brave_results(body: Column) -> Column:
    schema = "web STRUCT<results: ARRAY<STRUCT<url: STRING, title: STRING, description: STRING>>>"
    return _json_results(body, schema, "web.results", "url", "description")


def serpapi_results(body: Column) -> Column:
    schema = "organic_results ARRAY<STRUCT<link: STRING, title: STRING, snippet: STRING>>"
    return _json_results(body, schema, "organic_results", "link", "snippet")


def cse_results(body: Column) -> Column:
    schema = "items ARRAY<STRUCT<link: STRING, title: STRING, snippet: STRING>>"
    return _json_results(body, schema, "items", "link", "snippet")


def ddg_results(body: Column) -> Column:
    """First ten result anchors of the HTML page; blank targets keep their place in the ranking."""
    anchors = F.regexp_extract_all(body, F.lit(r"(?is)(<a\b[^>]*>.*?)</a\s*>"), F.lit(1))
    marked = F.filter(
        anchors,
        lambda a: F.regexp_extract(a, r"(?is)^<a\b[^>]*>", 0).rlike(
            r"""(?i)\bclass\s*=\s*["'](?:[^"']*\s)?result__a(?:\s[^"']*)?["']"""
        ),
    )
    return F.transform(
        F.slice(marked, 1, 10),
        lambda a: F.struct(
            unescape_html(F.regexp_extract(a, r"""(?i)\bhref\s*=\s*["']([^"']*)["']""", 1)).alias("url"),
            unescape_html(F.regexp_replace(a, r"(?s)<[^>]*>", "")).alias("title"),
            F.lit("").alias("snippet"),
        ),
    ).cast(f"ARRAY<{_RESULT}>")


PROVIDERS = {"brave": brave_results, "serpapi": serpapi_results, "google_cse": cse_results}


def search_rows(bodies: DataFrame, results: Column, skip_blank: bool = False) -> DataFrame:
    rows = bodies.select("product_id", "provider", F.posexplode(results).alias("rank", "r")).select(
        "product_id", "provider", "rank", "r.url", "r.title", "r.snippet"
    )
    return rows.filter(F.col("url") != "") if skip_blank else rows


def scan_search(bodies: DataFrame, provider: str) -> DataFrame:
    """Results of one provider's bodies (``product_id, provider, body``)."""
    if provider in PROVIDERS:
        return search_rows(bodies.filter(F.col("provider") == provider), PROVIDERS[provider](F.col("body")))
    return search_rows(bodies.filter(~F.col("provider").isin(*PROVIDERS)), ddg_results(F.col("body")), skip_blank=True)


def search_dispatch(bodies: DataFrame) -> DataFrame:
    """All providers in one pass over the bodies; an unknown name is read as the HTML form."""
    body, name = F.col("body"), F.col("provider")
    results = None
    for provider, parse in PROVIDERS.items():
        results = F.when(name == provider, parse(body)) if results is None else results.when(name == provider, parse(body))
    rows = search_rows(bodies, results.otherwise(ddg_results(body)))
    return rows.filter(name.isin(*PROVIDERS) | (F.col("url") != ""))


# ---- classifier answers ----

_ANSWER = (
    "page_is_correct_product: STRING, product_match_confidence: STRING, match_reasoning: STRING, "
    "images: ARRAY<STRUCT<url: STRING, role: STRING, confidence: STRING, reasoning: STRING>>, "
    "rejected: ARRAY<STRUCT<url: STRING, reason: STRING>>"
)


def json_object_text(text: Column) -> Column:
    """The JSON object in an answer: what stands inside a fence, else what stands from the first brace on.

    An answer that opens with a brace is taken to its end, so words behind the
    object make it unreadable; with words before it, it ends at its last brace.
    """

    def bounds(bare: Column) -> Column:
        fence = F.locate("```", bare)
        inside = F.substring_index(F.substr(bare, fence + 3), "```", 1)
        fenced = (fence > 0) & F.contains(inside, F.lit("{"))
        return F.when(fenced, strip(F.regexp_replace(inside, "^json", ""))).otherwise(bare)

    def braced(picked: Column) -> Column:
        first, tail = F.locate("{", picked), F.locate("}", F.reverse(picked))
        cut = F.substr(picked, first, F.length(picked) - tail - first + 2)
        return F.when((first <= 1) | (tail == 0), picked).otherwise(cut)

    return let(let(strip(text), bounds), braced)


def json_object(picked: Column, fields: str) -> Column:
    """One JSON object with double quotes as a struct; null if the text is anything else.

    The text is read as the inside of an array, which must then have exactly one
    element: a second object or words behind the first do not go unnoticed.
    """
    options = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}
    inside = F.concat(F.lit("["), F.when(picked.startswith("{") & picked.endswith("}"), picked), F.lit("]"))
    read = F.from_json(inside, "ARRAY<STRUCT<" + fields + ">>", options)
    return let(read, lambda all_of: F.when(F.size(all_of) == 1, F.get(all_of, F.lit(0))))


def classification(text: Column) -> Column:
    """Answer as a typed struct with ``parse_error``; numbers given as text are accepted.

    Quotes are double, and nothing follows the object.
    """
    return let(let(json_object_text(text), lambda picked: json_object(picked, _ANSWER)), lambda raw: _typed_answer(text, raw))


def _typed_answer(text: Column, raw: Column) -> Column:
    images = F.transform(
        raw["images"],
        lambda i: F.struct(
            i["url"].alias("url"),
            i["role"].alias("role"),
            F.coalesce(i["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence"),
            i["reasoning"].alias("reasoning"),
        ),
    )
    no_images = F.array().cast("ARRAY<STRUCT<url: STRING, role: STRING, confidence: DOUBLE, reasoning: STRING>>")
    return F.struct(
        raw.isNull().alias("parse_error"),
        F.coalesce(raw["page_is_correct_product"].isin("true", "1"), F.lit(False)).alias("page_is_correct_product"),
        F.coalesce(raw["product_match_confidence"].try_cast("double"), F.lit(0.0)).alias("product_match_confidence"),
        raw["match_reasoning"].alias("match_reasoning"),
        F.coalesce(images, no_images).alias("images"),
        F.coalesce(raw["rejected"], F.array().cast("ARRAY<STRUCT<url: STRING, reason: STRING>>")).alias("rejected"),
    )


def scan_answers(responses: DataFrame) -> DataFrame:
    """Add the parsed ``classification`` struct to response rows."""
    return with_once(responses, "classification", classification(F.col("text")))
