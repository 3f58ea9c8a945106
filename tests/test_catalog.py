import datetime as dt
import hashlib
import json
import struct
import zlib
from dataclasses import replace

from pyspark.sql import functions as F

from shelfsight.operators import candidates as C
from shelfsight.operators import discovery as D
from shelfsight.operators import jobs as J
from shelfsight.operators import lifecycle as L
from shelfsight.operators import products as P
from shelfsight.operators import review as V
from shelfsight.operators import selection as S
from shelfsight.operators.substrings import substring_hits
from shelfsight.operators.topk import with_blocks
from shelfsight.settings import DEFAULTS, Settings
from shelfsight.sources import bodies as B
from shelfsight.sources import images as I
from shelfsight.sources import parameters


def test_effective_manufacturer_order(rows):
    products = rows("product_id int, name string, manufacturer_override string",
                    (1, "Foo bar", " Acme "), (2, "Foo bar", "   "), (3, "Foo bar", ""), (4, "  Baz\tqux ", None), (5, None, None), (6, "Foo", None))
    lines = rows("product_id int, line_no int, attribute_name string, value_no int, value_name string",
                 (3, 0, " BRAND ", 0, None), (3, 1, "brand", 0, " Bosch "), (3, 1, "brand", 1, "X"), (4, 0, "Color", 0, "red"), (6, 0, "Brand", 0, " "))
    got = {r.product_id: r.effective_manufacturer for r in P.effective_manufacturer(products, lines).collect()}
    assert got == {1: "Acme", 2: "", 3: "Bosch", 4: "Baz", 5: "", 6: ""}


def test_sku_match_separators_and_limit(rows):
    urls = rows("host string, doc_path string, pos int, loc string", *[("h", "a", i, f"http://h/{p}") for i, p in enumerate(["AB-12/", "ab_1 2x", "ab3", "cab12"])], ("g", "a", 0, "http://g/ab12"))
    wanted = rows("host string, sku string", ("h", "AB 12"), ("h", "-"), ("h", ""), ("h", "zz"), ("k", "ab12"))
    got = sorted(tuple(r) for r in D.sku_url_match(urls, wanted, limit=3).collect())
    assert [g[1:3] + (g[3][9:],) for g in got if g[1] == "AB 12"] == [("AB 12", 1, "AB-12/"), ("AB 12", 2, "ab_1 2x"), ("AB 12", 3, "cab12")]
    assert [g[2] for g in got if g[1] == "-"] == [1, 2, 3] and len(got) == 6


def test_substring_hits_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts = [(i, rng.choice("xy"), word(rng.randint(0, 12))) for i in range(150)]
    needles = sorted({(rng.choice("xyz"), word(rng.randint(0, 4))) for _ in range(60)})
    t = spark.createDataFrame(texts, "id int, k string, s string")
    n = spark.createDataFrame(needles, "k string, needle string")
    got = sorted((r.id, r.k, r.needle) for r in substring_hits(t, "s", n, "needle", ["k"]).collect())
    assert got == sorted((i, k, w) for i, k, s in texts for kk, w in needles if k == kk and w in s)


def test_long_and_short_needles_by_their_rarest_piece(spark):
    """Needles of many lengths; pieces that all texts share, repeated rows, and needles that no text holds."""
    import random

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    texts = [(rng.choice("xy"), "common-" + word(rng.randint(0, 20))) for _ in range(120)]
    texts += texts[:10]
    needles = sorted({(rng.choice("xy"), rng.choice(["", "common-", "mon-"]) + word(rng.randint(0, 9))) for _ in range(80)} | {("x", "absent")})
    t, n = spark.createDataFrame(texts, "k string, s string"), spark.createDataFrame(needles, "k string, needle string")
    want = sorted((k, s, w) for k, s in texts for kk, w in needles if k == kk and w in s)
    for gram in (4, 2):
        assert sorted((r.k, r.s, r.needle) for r in substring_hits(t, "s", n, "needle", ["k"], gram).collect()) == want
    alone = substring_hits(t.select("s"), "s", n.select("needle").distinct(), "needle", [])
    assert sorted((r.s, r.needle) for r in alone.collect()) == sorted((s, w) for _, s in texts for w in {w for _, w in needles} if w in s)


def test_blocks_are_ordered_ranges(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), (F.col("id") * 7919 % 4001).alias("v"))
    cut = with_blocks(df, ["k"], "v", parts=100, splits=16)
    spans = cut.filter("k = 'hot'").groupBy("block").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).orderBy("block").collect()
    assert len(spans) == 16 and max(s.n for s in spans) < 400
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]))
    assert cut.count() == 4000 and cut.filter("k <> 'hot' and block <> 0").count() == 0


def _walk(store, root):
    """Depth-first reading of the sitemap rules, as a reference for small cases."""
    seen = []

    def go(url, depth):
        if depth > 5 or url in seen or len(seen) > 100:
            return []
        seen.append(url)
        rows = sorted(r for r in store if r[0] == url)
        if not rows:
            return []
        if rows[0][1] == "urlset":
            return [r[3] for r in rows]
        return [u for r in rows for u in go(r[3], depth + 1)]

    return go(root, 0)


def test_sitemap_walk_cycles_caps_and_order(rows):
    store = [("r", "index", i, f"s{i}") for i in range(130)] + [("s3", "index", 0, "r"), ("s3", "index", 1, "deep"), ("s3", "index", 2, "s5")]
    store += [(f"s{i}", "urlset", 0, f"u{i}") for i in range(130) if i != 3] + [("deep", "urlset", j, f"d{j}") for j in range(3)]
    chain = [(f"c{i}", "index", 0, f"c{i + 1}") for i in range(8)] + [("c5", "urlset", 0, "never"), ("c8", "urlset", 0, "too deep"), ("c0", "index", 1, "side"), ("side", "urlset", 0, "ok")]
    chain = [r for r in chain if r != ("c5", "urlset", 0, "never")]
    df = rows("sitemap_url string, kind string, pos int, loc string", *store, *chain)
    roots = rows("sitemap_url string", ("r",), ("c0",), ("absent",))
    got = D.sitemap_expand(df, roots).orderBy("root", "doc_path", "pos").collect()
    for root, part in (("r", store), ("c0", chain), ("absent", [])):
        assert [r.loc for r in got if r.root == root] == _walk(part, root), root


def test_answers_in_all_wrappings(rows):
    obj = '{"page_is_correct_product": true, "product_match_confidence": "0.5", "images": [{"url": "u", "role": null, "confidence": 1}]}'
    df = rows("response_id int, text string", (1, obj), (2, f"```json\n{obj}\n```"), (3, f"Sure: {obj} done"), (4, "[1]"), (5, "no"), (6, '{"page_is_correct_product": false}'), (7, "{broken"), (8, None))
    got = {r.response_id: r.classification for r in B.scan_answers(df).collect()}
    assert [got[i].parse_error for i in range(1, 9)] == [False, False, False, True, True, False, True, True]
    assert all(got[i].product_match_confidence == 0.5 and got[i].images[0].confidence == 1.0 for i in (1, 2, 3))
    assert [r.response_id for r in C.classification_gate(B.scan_answers(df)).orderBy("response_id").collect()] == [1, 2, 3]


def test_downgraded_main_needs_the_gallery(rows):
    images = rows("product_id int, pos int, role string, has_white boolean, studio_answer string, gallery_enabled boolean",
                  (1, 0, "main", False, " studio", False), (2, 0, "main", False, "CONTEXT", False), (3, 0, "main", False, None, True), (4, 0, "main", True, None, False))
    got = {r.product_id: (r.role, r.has_white) for r in C.main_downgrade(images).collect()}
    assert got == {1: ("main", True), 3: ("in_use", False), 4: ("main", True)}
    loose = C.main_downgrade(images, Settings(strict_white_main=False))
    assert {r.role for r in loose.collect()} == {"main"}


def test_only_the_best_main_with_an_image_wins(rows):
    cands = rows("candidate_id string, product_id int, role string, confidence double, has_image_data boolean",
                 ("b", 1, "main", 0.5, True), ("a", 1, "main", 0.99, True), ("e", 1, "main", 1.0, False), ("c", 2, "main", 0.9, True), ("d", 3, "main", None, True))
    products = rows("product_id int, has_main_image boolean, main_image_normalized boolean", (1, True, False), (2, True, True), (3, False, True))
    state = lambda s: {r.candidate_id: r.state for r in V.apply_main_guard(cands, products, s).collect()}
    assert state(Settings()) == {"a": "applied", "b": "failed", "c": "failed", "d": "applied", "e": "failed"}
    assert state(Settings(overwrite_existing_main=True)) == {"a": "applied", "b": "applied", "c": "applied", "d": "applied", "e": "failed"}


def test_signatures_equal_python(rows):
    keys = {"bg_color": '#"a"', "jpeg_quality": 92, "output_format": "jpeg", "padding_percent": 8, "target_canvas_size": 1920, "white_threshold": 245}
    want = hashlib.sha256(json.dumps(keys, sort_keys=True).encode()).hexdigest()
    data = b"\x00\xff\x10"
    r = rows("b binary", (bytearray(data),)).select(
        L.settings_signature({k: F.lit(v) for k, v in keys.items()}).alias("s"), L.output_signature(F.col("b"), F.lit(want)).alias("o")
    ).collect()[0]
    assert r.s == want and r.o == hashlib.sha256(data + want.encode()).hexdigest()


def test_budget_edges(rows):
    now = dt.datetime(2024, 2, 29, 23, 59)
    costs = lambda *v: rows("created_at timestamp_ntz, cost_usd double", *v)
    edge = costs((dt.datetime(2024, 2, 1), 1.0), (dt.datetime(2024, 2, 29, 23, 59, 59, 999999), 2.0), (dt.datetime(2024, 1, 31, 23, 59, 59, 999999), 4.0), (dt.datetime(2024, 3, 1), 8.0))
    assert J.month_to_date(edge, now).collect()[0].spent_usd == 3.0
    jobs = rows("job_id int, state string", (1, "queued"), (2, "done"))
    alert = lambda spent, budget: {r.job_id: (r.state, r.budget_alert) for r in J.budget_decision(jobs, costs((now, spent)), now, budget).collect()}
    assert alert(50.0, 50.0) == {1: ("paused", "exhausted"), 2: ("done", "exhausted")}
    assert alert(40.0, 50.0)[1] == ("queued", "warning") and alert(39.9, 50.0)[1] == ("queued", "none") and alert(9e9, 0)[1] == ("queued", "none")
    assert J.alert_rows(jobs, costs((now, 60.0)), now, 50.0, "").count() == 0


def test_empty_roots_select_nothing(rows):
    products = rows("product_id int, category_id int", (1, 1), (2, None))
    tree = rows("category_id int, parent_id int", (1, None), (2, 1), (3, 2))
    assert S.by_category(products, tree, rows("category_id int")).count() == 0
    assert sorted(r.category_id for r in S.category_subtree(tree, rows("category_id int", (2,))).collect()) == [2, 3]


def test_typed_settings(rows):
    df = rows("scope_id int, name string, value string", (1, "a", "12.0"), (1, "b", "Yes"), (2, "a", " 7 "), (2, "b", "no"), (2, "c", "x"))
    got = [tuple(r) for r in parameters.typed(df, {"a": 5, "b": True, "c": 0.7}).orderBy("scope_id").collect()]
    assert got == [(1, 5, True, 0.7), (2, 7, False, 0.7)]


def _png(path, grid):
    h, w = len(grid), len(grid[0])
    raw = b"".join(b"\0" + b"".join(bytes(p) for p in row) for row in grid)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files_and_gzipped_sitemaps(spark, tmp_path):
    import gzip

    (tmp_path / "img").mkdir()
    _png(tmp_path / "img" / "a.png", [[(1, 2, 3, 4), (5, 6, 7, 8)]])
    (tmp_path / "img" / "bad.png").write_bytes(b"not an image")
    images = I.read_images(spark, str(tmp_path / "img"))
    assert images.count() == 1
    px = I.pixels_from_rasters(images).orderBy("x").collect()
    assert [(p.r, p.g, p.b, p.a) for p in px] == [(1, 2, 3, 4), (5, 6, 7, 8)]
    assert I.read_sizes(spark, str(tmp_path / "img")).count() == 2
    (tmp_path / "maps").mkdir()
    with gzip.open(tmp_path / "maps" / "s.xml.gz", "wb") as f:
        f.write(b'<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://x/1 </loc></url></urlset>')
    assert [r.loc for r in B.sitemap_store(B.read_sitemap_files(spark, str(tmp_path / "maps"))).collect()] == ["http://x/1"]


def test_state_after_applying_a_main(rows):
    products = rows(
        "product_id int, img string, orig string, has_main_image boolean, main_image_normalized boolean, main_image_already_white_bg boolean, normalization_signature string, enrichment_state string",
        (1, "old", None, True, False, True, None, "candidates_found"), (2, "old", "first", True, False, None, "s", "skipped"), (3, None, None, False, None, None, None, "error"),
        (4, "old", None, True, True, False, "s", "enriched"), (5, "old", None, True, False, False, "s", "no_results"))
    candidates = rows("candidate_id string, product_id int, role string, confidence double, has_white_background boolean",
                      ("a", 1, "main", 0.9, True), ("b", 1, "main", 0.8, False), ("c", 2, "main", None, None), ("d", 3, "main", 0.7, True), ("e", 4, "main", 1.0, True), ("f", 5, "main", 1.0, True))
    outputs = rows("candidate_id string, output string", ("a", "A"), ("b", "B"), ("c", "C"), ("d", "D"), ("e", "E"), ("f", None))
    sign = lambda x: hashlib.sha256((x + "sig").encode()).hexdigest()

    def after(settings):
        done = V.apply_main_guard(candidates, products, settings)
        out = L.apply_main_state(products, done, candidates, outputs, "img", "orig", F.lit("sig"), settings)
        return {r.product_id: (r.img, r.orig, r.main_image_normalized, r.main_image_already_white_bg, r.normalization_signature, r.enrichment_state) for r in out.collect()}

    got = after(DEFAULTS)
    assert got[1] == ("A", "old", True, True, sign("A"), "enriched") and got[2] == ("C", "first", True, False, sign("C"), "enriched")
    assert got[3] == ("D", None, True, True, sign("D"), "enriched")
    assert got[4] == ("old", None, True, False, "s", "enriched") and got[5] == ("old", None, False, False, "s", "no_results")
    got = after(replace(DEFAULTS, overwrite_existing_main=True, keep_backup=False))
    assert got[1][:2] == ("B", None) and got[4][:2] == ("E", None)
