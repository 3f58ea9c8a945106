"""Images on crawled pages.

A page is one row, so its inventory is an array built where the page is read:
extraction, de-duplication, filtering and the cap need no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.functions import markup as M
from shelfsight.functions.binding import let, with_once
from shelfsight.functions.text import contains_any, first_filled, strip
from shelfsight.functions.urls import base_parts, resolve_from

# fixed values: parts of image addresses that mark page furniture
JUNK_TOKENS = (
    "sprite", "icon", "logo", "flag-", "placeholder", "spinner", "social", "twitter", "facebook", "instagram", "/avatar",
)
SMALL_SIDE = 200
MAX_IMAGES_PER_PAGE = 60
RENDER_BELOW = 5

# what a page without images is answered with, in the form of a classifier's answer
NO_IMAGES_ANSWER = (
    '{"page_is_correct_product": false, "product_match_confidence": 0.0, "match_reasoning": "page has no images", "images": [], "rejected": []}'
)

IMAGE_FIELDS = ("pos", "url", "alt", "width", "height")


def _whole(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def inventory(html: Column, page_url: Column) -> Column:
    """All images with an address, as structs of ``IMAGE_FIELDS`` in document order."""
    sources = F.transform(
        F.transform(M.image_tags(html), M.attributes),
        lambda read, i: F.struct(
            i.alias("pos"), read.alias("read"), M.first_value(read, ("src", "data-src", "data-lazy-src")).alias("src")
        ),
    )
    image = lambda base, s: F.struct(
        s["pos"].alias("pos"),
        resolve_from(base, s["src"]).alias("url"),
        strip(M.value_of(s["read"], "alt")).alias("alt"),
        _whole(M.value_of(s["read"], "width")).alias("width"),
        _whole(M.value_of(s["read"], "height")).alias("height"),
    )
    return let(
        base_parts(page_url),
        lambda base: F.transform(F.filter(sources, lambda s: s["src"] != ""), lambda s: image(base, s)),
    )


def _reordered(images: Column, first: tuple[str, ...]) -> Column:
    fields = first + tuple(f for f in IMAGE_FIELDS if f not in first)
    return F.array_sort(F.transform(images, lambda i: F.struct(*[i[f].alias(f) for f in fields])))


def dedupe(images: Column) -> Column:
    """First occurrence of each address: sort by address, keep the head of each run, sort back."""
    heads = let(
        _reordered(images, ("url", "pos")),
        lambda s: F.filter(s, lambda i, k: (k == 0) | (F.get(s, k - 1)["url"] != i["url"])),
    )
    return _reordered(heads, ("pos",))


def is_junk(image: Column) -> Column:
    w, h = image["width"], image["height"]
    tiny = (w != 0) & (h != 0) & (w < SMALL_SIDE) & (h < SMALL_SIDE) & (image["alt"] == "")
    return tiny | let(F.lower(image["url"]), lambda url: url.endswith(".svg") | contains_any(url, JUNK_TOKENS))


def plausible(images: Column) -> Column:
    """What is worth classifying: first occurrences that are not page furniture, at most 60."""
    return F.slice(F.filter(dedupe(images), lambda i: ~is_junk(i)), 1, MAX_IMAGES_PER_PAGE)


def _clean(pages: DataFrame) -> DataFrame:
    return with_once(pages, "_html", M.without_noise(F.col("html")))


def _rows(pages: DataFrame, images: Column, *keep: str) -> DataFrame:
    return pages.select(*keep, F.col("url").alias("page_url"), F.inline(images))


def img_inventory(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per image with an address."""
    return _rows(_clean(pages), inventory(F.col("_html"), F.col("url")), *keep)


def img_dedupe(pages: DataFrame, *keep: str) -> DataFrame:
    """As above, first occurrence per address, decided before any filter."""
    return _rows(_clean(pages), dedupe(inventory(F.col("_html"), F.col("url"))), *keep)


def img_junk_filter(pages: DataFrame, *keep: str) -> DataFrame:
    images = F.filter(dedupe(inventory(F.col("_html"), F.col("url"))), lambda i: ~is_junk(i))
    return _rows(_clean(pages), images, *keep)


def img_cap(pages: DataFrame, *keep: str) -> DataFrame:
    return _rows(_clean(pages), plausible(inventory(F.col("_html"), F.col("url"))), *keep)


def with_images(pages: DataFrame, context: bool = True) -> DataFrame:
    """Pages with ``images``: the plausible ones, each with its surrounding text.

    The text needs element nesting, which expressions cannot follow; one
    Python helper returns it for all images of a page.
    """
    listed = with_once(_clean(pages), "images", plausible(inventory(F.col("_html"), F.col("url"))))
    if not context:
        return listed.drop("_html")
    texts = listed.withColumn("_context", M.image_contexts(F.col("_html")))
    return texts.withColumn(
        "images",
        F.transform(
            "images",
            lambda i: F.struct(
                *[i[f].alias(f) for f in IMAGE_FIELDS],
                F.coalesce(F.get(F.col("_context"), i["pos"]), F.lit("")).alias("context"),
            ),
        ),
    ).drop("_html", "_context")


def render_flag(pages: DataFrame) -> DataFrame:
    """Pages whose markup holds too few images to trust without rendering."""
    return _clean(pages).withColumn("n_img", F.size(M.image_tags(F.col("_html")))).withColumn(
        "needs_render", F.col("n_img") < RENDER_BELOW
    ).drop("_html")


def prompt_rows(requests: DataFrame) -> DataFrame:
    """Request text per (product, page); where the page has nothing to classify a fixed ``answer`` instead.

    ``requests`` has product columns ``name, manufacturer_sku, default_code,
    effective_manufacturer, category_name`` and page columns ``page_url, images``.
    """
    # fixed format: what the classifier is shown
    quoted = lambda label, c, n: F.concat(F.lit(f'{label}="'), F.substring(c, 1, n), F.lit('"'))
    line = lambda i: F.concat(
        F.lit("- url="), i["url"], F.lit(" | "), quoted("alt", i["alt"], 100),
        F.lit(" | w="), i["width"].cast("string"), F.lit(" h="), i["height"].cast("string"),
        F.lit(" | "), quoted("context", i["context"], 160),
    )
    product = F.concat_ws(
        "\n",
        F.concat(F.lit("name: "), F.coalesce("name", F.lit(""))),
        F.concat(F.lit("sku: "), first_filled(F.col("manufacturer_sku"), F.col("default_code"))),
        F.concat(F.lit("manufacturer: "), F.coalesce("effective_manufacturer", F.lit(""))),
        F.concat(F.lit("category: "), F.nullif(F.col("category_name"), F.lit(""))),
    )
    n = F.size("images")
    text = F.concat(
        F.lit("PRODUCT CONTEXT:\n"), product, F.lit("\n\nPAGE URL: "), F.col("page_url"),
        F.lit("\n\nIMAGES ("), n.cast("string"), F.lit(" candidates):\n"), F.array_join(F.transform("images", line), "\n"),
    )
    return requests.withColumn("n_images", n).withColumn("request_text", F.when(n > 0, text)).withColumn(
        "answer", F.when(n == 0, F.lit(NO_IMAGES_ANSWER))
    )
