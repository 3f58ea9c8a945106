import random

import pytest
from pyspark.sql import functions as F

from shelfsight.functions import markup as M
from shelfsight.operators import fetching as G
from shelfsight.operators import inventory as N
from shelfsight.operators import recipes as C

PAGE = """<html><head><title>T</title><script>var a='<img src="no.png">';</script></head><body><!-- <img src="gone.png"> -->
<div id="top"><p>short</p><figure class="shot big"><img SRC='/a.jpg' alt=" A > B " width="100%" height=300></figure></div>
<img src="" data-src="/b.jpg" width=150 height=150><img data-lazy-src="/b.jpg" alt="again" width=900>
<img src="/icons/x.png" alt="x"><img src="/c.SVG"><img alt="none"><img src="d.jpg?x=1&amp;y=2">
<svg><img src="/in-svg.jpg"></svg></body></html>"""


def _pages(rows, *html):
    return rows("page_id int, url string, html string", *[(i, "http://h.example.com/p/q", h) for i, h in enumerate(html)])


def test_inventory_order_attributes_and_sources(rows):
    got = [tuple(r)[2:] for r in N.img_inventory(_pages(rows, PAGE), "page_id").collect()]
    assert got == [
        (0, "http://h.example.com/a.jpg", "A > B", 0, 300),
        (1, "http://h.example.com/b.jpg", "", 150, 150),
        (2, "http://h.example.com/b.jpg", "again", 900, 0),
        (3, "http://h.example.com/icons/x.png", "x", 0, 0),
        (4, "http://h.example.com/c.SVG", "", 0, 0),
        (6, "http://h.example.com/p/d.jpg?x=1&y=2", "", 0, 0),
    ]


def test_first_occurrence_decides_even_if_it_is_junk(rows):
    # /b.jpg is seen first as a tiny image without alt, so its later, larger twin is gone too
    got = [r.url.rsplit("/", 1)[1] for r in N.img_cap(_pages(rows, PAGE), "page_id").collect()]
    assert got == ["a.jpg", "d.jpg?x=1&y=2"]


def test_cap_is_sixty_and_render_flag_counts_tags(rows):
    many = "".join(f'<img src="/{i}.jpg">' for i in range(75))
    pages = _pages(rows, many, many[: len('<img src="/0.jpg">') * 4], "")
    counts = {r.page_id: r["count"] for r in N.img_cap(pages, "page_id").groupBy("page_id").count().collect()}
    assert counts == {0: 60, 1: 4}
    assert {r.page_id: (r.n_img, r.needs_render) for r in N.render_flag(pages).collect()} == {0: (75, False), 1: (4, True), 2: (0, True)}


def test_references_in_text_end_with_a_semicolon(rows):
    html = ["<div>a&amp;&amp b &copy;&copyx &lt;i&gt; &#65;&#66 &nosuch; &</div><div><img src='a.jpg'> x&amp</div>"]
    got = N.with_images(_pages(rows, html)).select(F.inline("images")).first()
    assert got.context == "x&amp"
    got = N.with_images(_pages(rows, [html[0].replace("</div><div>", "")])).select(F.inline("images")).first()
    assert got.context == "a&&amp b ©&copyx <i> A&#66 &nosuch; & x&amp"


def test_context_takes_the_nearest_ancestor_that_says_enough(rows):
    long = "word " * 40
    html = (
        f"<body><section>{long}<div><span>near</span><img src='/1.jpg'></div></section>"
        f"<ul><li>one<li>two<img src='/2.jpg'></ul></body><p>after</p>"
    )
    got = {r.pos: r.context for r in N.with_images(_pages(rows, html)).select(F.inline("images")).collect()}
    assert got[0] == (" ".join([long.strip(), "near"]))[:300]
    assert got[1].startswith(long.strip()[:50]) and len(got[1]) <= 300


def test_selectors():
    html = '<div class="g x"><p><img class="a b" id="i" src="1"></p><img data-k="zoom-1" src="2"></div><img src="3" data-src="4">'
    pick = lambda sel, attr="src": M._sources_of(html, sel, attr)
    assert pick("div.g img")["sources"] == ["1", "2"]
    assert pick("div > img")["sources"] == ["2"]
    assert pick("img.a.b#i, [data-k^=zoom]")["sources"] == ["1", "2"]
    assert pick("img", "data-src")["sources"] == ["1", "2", "4"]
    assert pick("")["sources"] == [] and pick("img:first-child") == {"ok": False, "sources": []}


def test_recipe_extract_main_gallery_and_exclusions(rows):
    html = '<div class="g"><img class="hero" src="/thumb.jpg"><img src="/a.jpg"><img src="/a.jpg"><img data-z="/b.jpg" src="/x.jpg"></div>'
    recipes = rows(
        "domain string, recipe_built boolean, active boolean, main_image_selector string, gallery_image_selector string, image_url_attribute string, excluded_url_patterns string",
        ("h.example.com", True, True, "img.hero", ".g img", "data-z", " THUMB ,"), ("other", True, True, "img", "img", "src", ""),
    )
    got = C.recipe_extract(_pages(rows, html), recipes).select(F.inline("images")).collect()
    assert [(r.url.rsplit("/", 1)[1], r.role, r.confidence) for r in got] == [("a.jpg", "angle", 0.85), ("b.jpg", "angle", 0.85)]
    broken = recipes.withColumn("main_image_selector", F.lit("img:nth-child(2"))
    r = C.recipe_extract(_pages(rows, html), broken).collect()[0]
    assert not r.readable and r.images == []


def test_recipe_pages_reach_python_once_and_in_small_batches(rows):
    recipes = rows(
        "domain string, recipe_built boolean, active boolean, main_image_selector string, gallery_image_selector string, image_url_attribute string, excluded_url_patterns string",
        ("h.example.com", True, True, "img.hero", "img", "src", None),
    )
    found = C.recipe_extract(_pages(rows, '<img class="hero" src="/a.jpg"><img src="/b.jpg">', None), recipes)
    flat = found.select("page_id", F.posexplode("images").alias("pos", "i")).filter("readable or pos = 0").select("page_id", "pos", "i.url", "i.role")
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "ArrowEvalPython" not in plan
    assert sorted((r.pos, r.url.rsplit("/", 1)[1], r.role) for r in flat.collect()) == [(0, "a.jpg", "main"), (1, "b.jpg", "angle")]


def test_pages_reach_python_once_for_contexts(rows):
    listed = N.with_images(_pages(rows, "<p>near<img src='/a.jpg'></p>", None)).select("page_id", F.inline("images"))
    plan = listed.filter("context <> ''")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "ArrowEvalPython" not in plan
    assert [(r.page_id, r.context) for r in listed.collect()] == [(0, "near")]


def test_politeness_matches_the_sequential_loop(spark):
    import random

    rng = random.Random(2)
    data = [(i, f"h{min(rng.randint(0, 9), 4)}", round(rng.uniform(0, 500), 2)) for i in range(3000)]
    df = spark.createDataFrame(data, "request_id long, host string, arrival_s double")
    got = {r.request_id: r for r in G.politeness_schedule(df, 2.0).collect()}
    last, seq = {}, {}
    for i, host, at in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        start = at if host not in last else max(at, last[host] + 2.0)
        assert abs(got[i].start_s - start) < 1e-6 and got[i].seq == seq.get(host, 0)
        last[host], seq[host] = start, seq.get(host, 0) + 1


def test_page_and_download_gates(rows):
    pages = rows("page_id int, url string, status int, content_type string, html string",
                 (1, "u", 200, "TEXT/HTML", "x"), (2, "u", 404, "text/html", "x"), (3, "u", 200, "text/html", ""), (4, "u", 200, None, "x"),
                 (5, "u", 200, "text/html", "Please VERIFY you are a human"))
    assert [r.page_id for r in G.page_gate(pages).collect()] == [1]
    files = rows("id int, url string, status int, content_type string, n_bytes long",
                 (1, "http://x/a", 200, "IMAGE/png", 10), (2, "http://x/a.JPG", 200, None, 10485760), (3, "http://x/a.gif", 200, "", 5),
                 (4, "http://x/a.png", 200, "text/html", 10485761), (5, "http://x/a.png", 200, "text/html", 1))
    assert [(r.id, r.mimetype) for r in G.download_gate(files).orderBy("id").collect()] == [(1, "image/png"), (2, "image/jpeg"), (5, "text/html")]


def test_robots_first_match_and_agent(rows):
    rules = rows("host string, agent string, ord int, allow boolean, path string",
                 ("a", "*", 0, False, "/x"), ("a", "*", 1, True, "/"), ("a", "imagebot", 2, False, ""), ("b", "imagebot", 0, False, "/"), ("c", "other", 0, False, "/"))
    urls = rows("url string", ("http://a/x/1",), ("http://b/",), ("http://c/1",), ("http://d/1",))
    got = lambda ua: {r.url: r.allowed for r in G.robots_gate(urls, rules, ua).collect()}
    assert got("ImageBot/2") == {"http://a/x/1": True, "http://b/": False, "http://c/1": True, "http://d/1": True}
    assert got("Else/1") == {"http://a/x/1": False, "http://b/": True, "http://c/1": True, "http://d/1": True}


@pytest.mark.parametrize("parts", ["1", "7"])
def test_pacing_carries_over_range_borders(spark, rows, parts):
    """One host holds most requests, many arrive at once, and some have no host."""
    rng = random.Random(8)
    data = [(i, "hot" if i % 4 else rng.choice(["a", "b", None, "z"]), float(rng.choice([0, 0, 5, rng.random() * 300]))) for i in range(900)]
    df = rows("request_id long, host string, arrival_s double, part string", *[(*d, "clash") for d in data])
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.request_id: (r.seq, round(r.start_s, 6)) for r in G.politeness_schedule(df, 1.5).collect()}
        assert G.politeness_schedule(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, last = {}, {}
    for i, host, at in sorted(data, key=lambda r: (r[1] or "", r[2], r[0])):
        seq, start = last.get(host, (-1, None))
        start = at if start is None else max(at, start + 1.5)
        want[i], last[host] = (seq + 1, round(start, 6)), (seq + 1, start)
    assert got == want
