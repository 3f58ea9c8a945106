"""Finding candidate pages: search results, sitemaps, SKU matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.functions import urls as U
from shelfsight.functions.text import contains_any, erase_separators, filled, strip
from shelfsight.operators.joins import many, unique
from shelfsight.operators.substrings import substring_hits
from shelfsight.operators.topk import first_n
from shelfsight.session import materialized
from shelfsight.sources.bodies import MAX_URLS_PER_SITEMAP

# fixed values: shops and social sites whose pages are never taken
BAD_HOST_TOKENS = (
    "amazon.", "ebay.", "walmart.", "aliexpress.", "wish.", "pinterest.",
    "reddit.", "facebook.", "youtube.com", "tiktok.", "instagram.",
)
# fixed values: document endings that are not pages
BAD_ENDINGS = (".pdf", ".doc", ".xls", ".ppt")

MAX_DEPTH = 5
MAX_VISITED = 101
MAX_SKU_HITS = 10
MAX_PAGES = 5
ENOUGH_SITEMAP_HITS = 3

# ---- search ----


def search_query_text(products: DataFrame) -> DataFrame:
    """Query text per product: manufacturer, SKU and name, at most 200 characters; null for no search."""
    parts = [filled(strip(F.coalesce(c, F.lit("")))) for c in ("effective_manufacturer", "effective_sku", "name")]
    text = F.substring(F.concat_ws(" ", *parts), 1, 200)
    return products.withColumn("query_text", filled(text))


def search_result_filter(results: DataFrame) -> DataFrame:
    """Drop results without URL, on shop or social hosts, or pointing at documents."""
    url = F.col("url")
    document = F.lower(U.path(url)).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in BAD_ENDINGS) + ")$")
    return results.filter((url != "") & ~contains_any(F.lower(U.netloc(url)), BAD_HOST_TOKENS) & ~document)


def search_result_rank(results: DataFrame) -> DataFrame:
    """Add ``host_rank``: 0 where the host matches the manufacturer. Order is host_rank, rank, url."""
    return results.withColumn(
        "host_rank",
        F.when(U.host_matches_for_ranking(F.col("url"), F.lower("effective_manufacturer")), 0).otherwise(1),
    )


# ---- sitemaps ----


def host_guesses(products: DataFrame) -> DataFrame:
    """Two likely hosts per product with a manufacturer, in order of preference."""
    name = F.lower(strip(F.coalesce("effective_manufacturer", F.lit(""))))
    blank = F.lit(" ")
    guesses = F.array(
        F.concat(F.replace(name, blank, F.lit("")), F.lit(".com")),
        F.concat(F.replace(name, blank, F.lit("-")), F.lit(".com")),
    )
    return products.filter(name != "").select(*products.columns, F.posexplode(guesses).alias("guess_no", "host"))


def sitemap_addresses(hosts: DataFrame) -> DataFrame:
    """The four addresses a host's sitemap is looked for at, in order of preference."""
    bare = U.sitemap_host(F.col("host"))
    return hosts.select(
        "host",
        F.posexplode(
            F.array(
                F.concat(F.lit("https://"), bare, F.lit("/sitemap.xml")),
                F.concat(F.lit("https://"), bare, F.lit("/sitemap_index.xml")),
                F.concat(F.lit("https://www."), bare, F.lit("/sitemap.xml")),
                F.concat(F.lit("https://"), bare, F.lit("/sitemap-index.xml")),
            )
        ).alias("preference", "sitemap_url"),
    )


def sitemap_candidates(hosts: DataFrame, non_empty: DataFrame) -> DataFrame:
    """Per host the first address whose sitemap yields anything (``non_empty``: sitemap_url)."""
    return (
        sitemap_addresses(hosts.select("host").distinct())
        .join(non_empty.select("sitemap_url").distinct(), "sitemap_url", "left_semi")
        .groupBy("host")
        .agg(F.min_by("sitemap_url", "preference").alias("sitemap_url"), F.min("preference").alias("preference"))
    )


def sitemap_nodes(
    store: DataFrame,
    roots: DataFrame,
    max_depth: int = MAX_DEPTH,
    max_visited: int = MAX_VISITED,
    max_urls: int | None = MAX_URLS_PER_SITEMAP,
) -> DataFrame:
    """Sitemaps with addresses that a walk from each root reads: ``root, sitemap_url, doc_path``.

    ``store`` has ``sitemap_url, kind, pos, loc``. Document order is a path of
    zero-padded positions, so a sitemap sorts after its parent and before its
    parent's later siblings. A root reads its first ``max_visited`` distinct
    sitemaps in that order. One with that many known predecessors can never be
    read, so children per index and sitemaps per root are cut to that number
    after every step; this bounds the child arrays and the list of a root below.
    The walk goes breadth first over a table keyed by root: a round joins the
    sitemaps reached last with their children and keeps, per root, the first ones
    in document order; it is written, and the walk ends when a round reaches
    nothing. Roots that the store does not hold are never walked. An index starts its next child
    only while its earlier children gave fewer than ``max_urls`` addresses; every
    index counts for itself. ``max_urls`` None is no limit.
    """
    index = store.filter(F.col("kind") == "index")
    children = materialized(
        first_n(index.groupBy("sitemap_url", "loc").agg(F.min("pos").alias("pos")), ["sitemap_url"], ["pos", "loc"], max_visited)
        .select(F.col("sitemap_url").alias("node"), "pos", "loc"),
        "sitemap-children",
    )
    held = roots.select("sitemap_url").distinct().join(many(store.select("sitemap_url").distinct()), "sitemap_url", "left_semi")
    walk = materialized(
        held.select(
            F.col("sitemap_url").alias("root"), F.col("sitemap_url").alias("node"),
            F.struct(F.lit("").alias("doc_path"), F.lit(0).alias("depth")).alias("at"),
        ),
        "sitemap-walk",
    )
    for step in range(max_depth):
        last = walk.filter(F.col("at.depth") == step)
        if step and last.isEmpty():
            break
        path = F.concat(F.col("at.doc_path"), F.lpad(F.col("pos").cast("string"), 8, "0"), F.lit(" "), F.col("loc"), F.lit("/"))
        reached = last.join(many(children), "node").select(
            "root", F.col("loc").alias("node"), F.struct(path.alias("doc_path"), F.lit(step + 1).alias("depth")).alias("at")
        )
        # both the grouping and the limit find their rows together by root
        merged = walk.unionByName(reached).repartition("root").groupBy("root", "node").agg(F.min("at").alias("at"))
        walk = materialized(first_n(merged, ["root"], ["at"], max_visited), "sitemap-walk")
    sizes = _pages(store, max_urls).groupBy(F.col("sitemap_url").alias("node")).agg(F.count("*").alias("_n"))
    sized = walk.join(many(sizes), "node", "left").select(
        "root", F.struct("at.doc_path", "at.depth", "node", F.coalesce("_n", F.lit(0)).alias("n")).alias("s")
    )
    limit = max_urls if max_urls is not None else (1 << 62)
    # at most max_visited sitemaps of a root, in document order
    read = sized.groupBy("root").agg(F.array_sort(F.collect_list("s")).alias("_all")).select(
        "root", F.inline(_started(F.col("_all"), max_depth, limit))
    )
    return read.filter("n > 0").select("root", F.col("node").alias("sitemap_url"), "doc_path")


def _started(sitemaps: Column, max_depth: int, limit: int) -> Column:
    """Those of a root's sitemaps (doc_path, depth, node, n; in document order) that the walk starts.

    A fold over the list with, per depth on the way to the current sitemap, the
    addresses so far and whether the index there was started.
    """
    kind = "struct<doc_path:string,depth:int,node:string,n:bigint>"
    levels = range(max_depth + 1)

    def step(state: Column, s: Column) -> Column:
        depth = s["depth"]
        above = lambda name: F.get(state[name], depth - 1)
        runs = (depth == 0) | (above("open") & (above("sums") < limit))
        sums = [
            F.when(depth <= k, F.lit(0).cast("long")).otherwise(state["sums"][k] + F.when(runs, s["n"]).otherwise(0)) for k in levels
        ]
        started = [F.when(depth == k, runs).when(depth < k, False).otherwise(state["open"][k]) for k in levels]
        kept = F.when(runs, F.concat(state["kept"], F.array(s.cast(kind)))).otherwise(state["kept"])
        return F.struct(F.array(*sums).alias("sums"), F.array(*started).alias("open"), kept.alias("kept"))

    start = F.struct(
        F.array(*[F.lit(0).cast("long") for _ in levels]).alias("sums"),
        F.array(*[F.lit(False) for _ in levels]).alias("open"),
        F.array().cast(f"array<{kind}>").alias("kept"),
    )
    return F.aggregate(sitemaps, start, step, lambda state: state["kept"])


def _pages(store: DataFrame, max_urls: int | None) -> DataFrame:
    """Address rows of page sitemaps; a single sitemap gives at most its first ``max_urls``."""
    pages = store.filter(F.col("kind") == "urlset")
    return pages if max_urls is None else pages.filter(F.col("pos") < max_urls)


def _addresses_of(store: DataFrame, nodes: DataFrame, max_urls: int | None) -> DataFrame:
    return nodes.join(many(_pages(store, max_urls).drop("kind")), "sitemap_url")


def sitemap_expand(store: DataFrame, roots: DataFrame, max_urls: int | None = MAX_URLS_PER_SITEMAP) -> DataFrame:
    """All page addresses under each root sitemap; document order is ``doc_path, pos``."""
    return _addresses_of(store, sitemap_nodes(store, roots, max_urls=max_urls), max_urls).select(
        "root", "sitemap_url", "doc_path", "pos", "loc"
    )


def site_urls(store: DataFrame, hosts: DataFrame, max_urls: int | None = MAX_URLS_PER_SITEMAP) -> DataFrame:
    """Page addresses per host, from the first of its four sitemap addresses that yields any.

    The choice is made among sitemaps, at most four roots of 101 each per host.
    """
    addresses = sitemap_addresses(hosts.select("host").distinct())
    nodes = sitemap_nodes(store, addresses.select("sitemap_url"), max_urls=max_urls)
    best = Window.partitionBy("host")
    chosen = (
        nodes.join(addresses.select("host", "preference", F.col("sitemap_url").alias("root")), "root")
        .withColumn("_best", F.min("preference").over(best))
        .filter(F.col("preference") == F.col("_best"))
        .select("host", "sitemap_url", "doc_path")
    )
    return _addresses_of(store, chosen, max_urls).select("host", "doc_path", "pos", "loc")


def needle_of(sku: Column) -> Column:
    """A SKU as it is searched for. Comparing with separators erased covers the plain comparison too."""
    return erase_separators(strip(sku))


def needle_hits(addresses: DataFrame, needles: DataFrame, limit: int = MAX_SKU_HITS) -> DataFrame:
    """First ``limit`` addresses per distinct (host, needle) in document order."""
    hits = substring_hits(
        addresses.withColumn("_text", erase_separators(F.col("loc"))), "_text", needles.select("host", "needle").distinct(), "needle", ["host"]
    )
    return first_n(hits, ["host", "needle"], ["doc_path", "pos"], limit, "place").select("host", "needle", "place", "loc")


def sku_url_match(addresses: DataFrame, wanted: DataFrame, limit: int = MAX_SKU_HITS) -> DataFrame:
    """First ``limit`` addresses per (host, sku) that contain the SKU.

    A SKU made only of separators matches every address. ``addresses`` has
    ``host, doc_path, pos, loc``; ``wanted`` has ``host, sku``.
    """
    asked = wanted.filter(F.col("sku") != "").select("host", "sku", needle_of(F.col("sku")).alias("needle")).distinct()
    return asked.join(many(needle_hits(addresses, asked, limit)), ["host", "needle"]).select("host", "sku", "place", "loc")


def discover_pages(products: DataFrame, store: DataFrame, results: DataFrame) -> DataFrame:
    """Up to five pages per product: sitemap hits of the first productive host guess, then search results.

    ``products`` needs ``effective_manufacturer`` and ``effective_sku``. Sitemap
    hits are not de-duplicated; search results are, against both. A product
    with fewer than three hits can lose at most two search results to them, so
    seven results per product decide; all arrays here hold at most ten items.
    """
    facts = products.select("product_id", "effective_manufacturer", "effective_sku")
    guesses = host_guesses(facts.filter(F.col("effective_sku") != "")).select(
        "product_id", "guess_no", "host", needle_of(F.col("effective_sku")).alias("needle")
    )
    ordered = lambda *cols: F.sort_array(F.collect_list(F.struct(*cols)))
    matched = (
        needle_hits(site_urls(store, guesses), guesses)
        .groupBy("host", "needle")
        .agg(F.transform(ordered("place", "loc"), lambda h: h["loc"]).alias("_hits"))
    )
    from_sitemap = guesses.join(unique(matched), ["host", "needle"]).groupBy("product_id").agg(
        F.min_by("_hits", "guess_no").alias("_hits")
    )
    ranked = (
        search_result_rank(search_result_filter(results).join(unique(facts), "product_id"))
        .groupBy("product_id", "url")
        .agg(F.min(F.struct("host_rank", "rank")).alias("_key"))
    )
    from_search = (
        first_n(ranked, ["product_id"], ["_key", "url"], MAX_PAGES + ENOUGH_SITEMAP_HITS - 1, "_place")
        .groupBy("product_id")
        .agg(F.transform(ordered("_place", "url"), lambda r: r["url"]).alias("_found"))
    )
    none = F.array().cast("array<string>")
    hits, found = F.coalesce("_hits", none), F.coalesce("_found", none)
    page = lambda how: lambda u: F.struct(u.alias("page_url"), F.lit(how).alias("found_by"))
    pages = F.concat(
        F.transform(hits, page("sitemap")),
        F.when(F.size(hits) < ENOUGH_SITEMAP_HITS, F.transform(F.array_except(found, hits), page("search"))).otherwise(
            F.array().cast("array<struct<page_url: string, found_by: string>>")
        ),
    )
    return (
        facts.select("product_id")
        .join(unique(from_sitemap), "product_id", "left")
        .join(unique(from_search), "product_id", "left")
        .select("product_id", F.posexplode(F.slice(pages, 1, MAX_PAGES)).alias("page_pos", "p"))
        .select("product_id", "page_pos", "p.page_url", "p.found_by")
    )
