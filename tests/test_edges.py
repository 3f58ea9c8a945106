"""Edge rows: limits, guards and answers that samples rarely hold."""

import gzip
import struct
import zlib

from pyspark.sql import functions as F

from shelfsight.functions import markup as M
from shelfsight.functions.text import unescape_html
from shelfsight.operators import discovery as D
from shelfsight.operators import fetching as H
from shelfsight.operators import jobs as J
from shelfsight.operators import inventory as N
from shelfsight.operators import recipes as R
from shelfsight.operators import selection as S
from shelfsight.sources import bodies as B
from shelfsight.sources import images as I
from shelfsight.sources import sinks
from shelfsight.streaming.versions import VersionedTables


def _store(rows):
    index = lambda url, *kids: [(url, "index", i, k) for i, k in enumerate(kids)]
    pages = lambda url, n: [(url, "urlset", i, f"{url}/{i}") for i in range(n)]
    data = index("root", "a", "b", "c") + pages("a", 2) + index("b", "b1", "b2", "b3") + pages("b1", 2) + pages("b2", 2) + pages("b3", 9) + pages("c", 1)
    return rows("sitemap_url string, kind string, pos int, loc string", *data)


def test_every_index_counts_its_own_addresses(rows):
    store, roots = _store(rows), rows("sitemap_url string", ("root",), ("b",))
    got = lambda limit: sorted((r.root, r.sitemap_url) for r in D.sitemap_nodes(store, roots, max_urls=limit).collect())
    # root reads a (2), then all that b yields (b1, b2: 4 in all), and then has enough
    assert got(3) == [("b", "b1"), ("b", "b2"), ("root", "a"), ("root", "b1"), ("root", "b2")]
    assert [r.loc for r in D.sitemap_expand(store, rows("sitemap_url string", ("root",)), max_urls=3).orderBy("doc_path", "pos").collect()] == [
        "a/0", "a/1", "b1/0", "b1/1", "b2/0", "b2/1",
    ]
    assert got(1) == [("b", "b1"), ("root", "a")]
    everything = [("b", "b1"), ("b", "b2"), ("b", "b3"), ("root", "a"), ("root", "b1"), ("root", "b2"), ("root", "b3"), ("root", "c")]
    assert got(None) == got(50_000) == everything


def test_zone_does_not_open_the_guard(rows):
    ips = rows("host string, ip string", ("a", "fe80::1%eth0"), ("b", "2606:2800:220:1::1%2"), ("c", "8.8.8.8"), ("c", "FE80::9%en0"))
    got = {r.host: r.all_public for r in H.host_verdicts(ips).collect()}
    assert got == {"a": False, "b": True, "c": False}


def test_numeric_entities(rows):
    data = [("b.jpg&#038;w=1", "b.jpg&w=1"), ("&#x20AC;&#X41;", "€A"), ("&#128512;", "😀"), ("&#0;&#xD800;", "��"), ("&#;&#x;&amp;#65;", "&#;&#x;&#65;"), ("plain", "plain"), (None, None)]
    df = rows("raw string, want string", *data).select(unescape_html(F.col("raw")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_answers_must_be_plain_json_to_their_end(rows):
    good = '{"page_is_correct_product": true, "product_match_confidence": "0.5"}'
    data = [
        (0, good), (1, f"```json\n{good}\n```"), (2, f"Here it is: {good} Done."), (3, f"{good} Hope this helps!"),
        (4, good.replace('"', "'")), (5, None), (6, ""), (7, "no braces"), (8, "```\nnothing\n```"), (9, "{"), (10, f"  {good}\n"),
    ]
    got = {r.i: r.classification for r in B.scan_answers(rows("i int, text string", *data)).collect()}
    assert {i for i, c in got.items() if not c.parse_error} == {0, 1, 2, 10}
    assert got[2].page_is_correct_product and got[1].product_match_confidence == 0.5


def test_paused_jobs_keep_their_pending_products(rows):
    jobs = rows("job_id int, state string, success_count int, failure_count int, processed_count int", (1, "paused", 0, 0, 0), (2, "running", 1, 0, 1), (3, "queued", 0, 0, 0))
    pending = rows("job_id int, product_id int, pending boolean", (1, 1, True), (1, 2, True), (2, 1, True), (2, 2, True), (3, 1, True))
    done = rows("job_id int, product_id int, success int, failure int, white_bg int, rembg int", (1, 1, 1, 0, 0, 1), (2, 1, 1, 0, 0, 1), (3, 1, 0, 1, 0, 0))
    got = {r.job_id: (r.state, r.pending_left, r.processed_count) for r in J.progress(jobs, pending, done).collect()}
    assert got == {1: ("paused", 2, 0), 2: ("running", 1, 2), 3: ("done", 0, 1)}


def test_one_channel_is_grey(rows):
    raster = rows("image_id int, width int, height int, n_channels int, data binary", (1, 3, 1, 1, bytearray([10, 20, 30])))
    got = sorted((r.x, r.r, r.g, r.b, r.a) for r in I.pixels_from_rasters(raster).collect())
    assert got == [(0, 10, 10, 10, 255), (1, 20, 20, 20, 255), (2, 30, 30, 30, 255)]


def test_two_byte_samples_hold_what_a_byte_cannot(rows):
    raster = rows("image_id int, width int, height int, n_channels int, sample_bytes int, data binary", (1, 2, 1, 1, 2, bytearray.fromhex("0108FFFD")))
    got = sorted((r.x, r.r, r.a) for r in I.pixels_from_rasters(raster).collect())
    assert got == [(0, 264, 255), (1, -3, 255)]
    sums = I.raster_border_sums(raster, 255).first()
    assert (sums.ring, sums.ring_white) == (6, 3)


def test_hot_host_with_equal_arrivals_is_cut(rows):
    from shelfsight.operators.topk import with_blocks

    df = rows("host string, arrival_s double, request_id int", *[("hot", 0.0, i) for i in range(5000)], ("cold", 1.0, 9999))
    got = with_blocks(df, ["host"], ["arrival_s", "request_id"], splits=16).collect()
    by_block = {}
    for r in got:
        if r.host == "hot":
            by_block.setdefault(r.block, []).append(r.request_id)
    assert len(by_block) > 8 and max(map(len, by_block.values())) < 1500 and len(got) == 5001
    ends = [(min(v), max(v)) for _, v in sorted(by_block.items())]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    paced = H.politeness_schedule(df, 2.0).filter("host = 'hot'").orderBy("request_id").collect()
    assert [(r.seq, r.start_s) for r in paced] == [(i, 2.0 * i) for i in range(5000)]


def test_containment_keeps_repeats_and_payload(rows):
    from shelfsight.operators.substrings import substring_hits

    texts = rows("host string, t string, n int", ("a", "xx-abc-yy", 1), ("a", "xx-abc-yy", 1), ("a", "none", 2), ("b", "abc", 3), ("a", None, 4))
    needles = rows("host string, needle string", ("a", "abc"), ("a", "xx"), ("b", "zz"))
    got = sorted((r.host, r.t, r.n, r.needle) for r in substring_hits(texts, "t", needles, "needle", ["host"]).collect())
    assert got == [("a", "xx-abc-yy", 1, "abc")] * 2 + [("a", "xx-abc-yy", 1, "xx")] * 2


def test_answers_are_one_object(rows):
    good = ['{"page_is_correct_product": true}', 'Sure: {"notes": "x"}', 'a ```json {"notes": "}{"} ``` b', '{"notes": "it\'s"}', '[{"a":1}]x']
    bad = [None, "", "none", "{", '{...} and {"a":1}', '{"a":1}{"x":2}', '{"a":1}, {"x":2}', '{"a":1} and more', "{'a': 1}", '{"a":1} {"b":2} end']
    texts = rows("id int, text string", *enumerate([*good, *bad]))
    got = {r.id: r.classification.parse_error for r in B.scan_answers(texts).collect()}
    assert [i for i in sorted(got) if not got[i]] == list(range(len(good)))
    kept = {r.domain for r in R.recipe_ingest(texts.select(F.col("id").cast("string").alias("domain"), "text")).collect()}
    assert kept == {str(i) for i in range(len(good))}


def test_category_trees_with_cycles_and_depth(rows):
    chain = [(i, i - 1 if i else None) for i in range(1000)]
    cycle = [(2001, 2002), (2002, 2003), (2003, 2001), (2004, 2002), (2005, 2005), (2006, 9999)]
    tree = rows("category_id int, parent_id int", *chain, *cycle)
    under = lambda *roots: sorted(r.category_id for r in S.category_subtree(tree, rows("category_id int", *[(x,) for x in roots])).collect())
    assert under(990, 995, 990) == list(range(990, 1000))
    assert under(2003) == [2001, 2002, 2003, 2004]
    assert under(2005, 2006, 7777) == [2005, 2006] and under() == []


def test_updates_clear_columns_and_repeat(spark, rows, tmp_path):
    store = VersionedTables(spark, str(tmp_path), {"p": ["id"]})
    store.create({"p": sinks.with_versions(rows("id int, a string, b int", (1, "x", 1), (2, "y", 2), (3, None, 3)))})
    make = lambda *data: rows("id int, version long, columns array<string>, a string, b int", *data)
    read = lambda: {r.id: (r.a, r.b) for r in store.current("p").collect()}
    first = make((1, 5, ["a"], None, 9), (2, 5, ["a", "b"], "n", 7), (2, 6, ["b"], "no", None), (4, 5, ["a"], "q", 1))
    for _ in range(2):
        sinks.merge_updates(store, "p", first, 1)
        assert read() == {1: (None, 1), 2: ("n", None), 3: (None, 3)}
    sinks.merge_updates(store, "p", make((1, 4, ["a", "b"], "old", 8), (2, 6, ["b"], "", None)), 2)
    assert read() == {1: (None, 8), 2: ("n", None), 3: (None, 3)}


def test_partitioned_appends_do_not_sort(spark, tmp_path):
    context, name = spark.sparkContext, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    data = spark.range(0, 5000, 1, 2).withColumn("message", F.concat(F.lit("m"), "id"))
    for kinds in (3, 40):
        rows = data.withColumn("kind", F.nullif(F.col("id") % kinds, F.lit(0)).cast("int"))
        context.setJobGroup(f"append-{kinds}", "")
        sinks.append(rows, f"{tmp_path}/{kinds}", ("kind",))
        got = sinks.append(rows.limit(0), f"{tmp_path}/{kinds}", ("kind",))
        assert sorted(got.collect()) == sorted((r.id, r.message, r.kind) for r in rows.collect())
        assert spark.conf.get(name, None) == before
    context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("append-3")]
    stages = {s for j in jobs for s in j.stageIds}
    assert stages and all(context._jsc.sc().statusStore().lastStageAttempt(s).peakExecutionMemory() == 0 for s in stages)


def test_sitemap_files_are_inflated_by_content(spark, tmp_path):
    body = "<urlset><url><loc>http://x/é</loc></url></urlset>"
    for name, data in {"a.xml": gzip.compress(body.encode()), "b.xml.gz": gzip.compress(body.encode()), "c.xml": body.encode(),
                       "d.xml.gz": body.encode(), "e.xml": gzip.compress(body.encode())[:20]}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.sitemap_url[-8:].lstrip("/"): r.body for r in B.read_sitemap_files(spark, str(tmp_path)).collect()}
    assert [got[next(k for k in got if n in k)] for n in ("a.xml", "b.xml", "c.xml", "d.xml", "e.xml")] == [body, body, body, None, None]


def _png(w, h, *, end=True):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)), *[chunk(b"IDAT", b"IEND" * 9)] * 40, chunk(b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts if end else parts[:-1])


def _jpeg(w, h, segments=0, frame=0xC2):
    out = b"\xff\xd8"
    for _ in range(segments):
        out += b"\xff\xe2" + struct.pack(">H", 9) + b"\xff\xc0\x00\x11\x08\x00\x01"
    return out + b"\xff\xff\xff" + bytes([frame]) + struct.pack(">HBHHB", 8, 8, h, w, 3) + b"\xff\xda\x00\x02"


def test_image_sizes_of_all_formats(rows):
    riff = lambda kind, data: b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBP" + kind + struct.pack("<I", len(data)) + data
    cases = [
        (_png(70000, 3), "png", 70000, 3, True), (_png(5, 6, end=False), "png", 5, 6, False), (_png(5, 6)[:20], "png", None, None, False),
        (_jpeg(640, 480), "jpeg", 640, 480, True), (_jpeg(300, 65535, 3000, 0xC0), "jpeg", 300, 65535, True), (_jpeg(9, 9, 2, 0xC4), "jpeg", None, None, False),
        (_jpeg(640, 480, 5)[:40], "jpeg", None, None, False), (_jpeg(0, 480), "jpeg", 0, 480, False),
        (b"GIF89a" + struct.pack("<HHBBB", 258, 3, 0, 0, 0) + b";", "gif", 258, 3, True), (b"GIF87a\x01", "gif", None, None, False),
        (riff(b"VP8X", b"\0\0\0\0" + (999).to_bytes(3, "little") + (70000).to_bytes(3, "little")), "webp", 1000, 70001, True),
        (riff(b"VP8L", b"\x2f" + struct.pack("<I", (99) | (1999 << 14) | (1 << 28))), "webp", 100, 2000, True),
        (riff(b"VP8 ", b"\x30\x01\x00\x9d\x01\x2a" + struct.pack("<HH", 400 | 0x4000, 300)), "webp", 400, 300, True),
        (riff(b"VP8X", b"\0" * 10)[:-1], "webp", None, None, False), (riff(b"ABCD", b"\0" * 10), "webp", None, None, False),
        (b"plain text", None, None, None, False), (b"", None, None, None, False), (None, None, None, None, False),
    ]
    blobs = rows("image_id int, content binary", *[(i, c[0]) for i, c in enumerate(cases)])
    got = {r.image_id: (r.format, r.width, r.height, r.readable) for r in I.image_headers(blobs).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]


def test_tags_inside_attribute_values_are_no_images(rows):
    html = """<p title="a > b"><IMG src=a.jpg alt='x > y' width=3><div data-html="<img src='no.jpg'>"><imgx src=no><img/src="b.jpg" SRC="c.jpg"
      data-src='d.jpg'></div><img alt src="" data-src="e&amp;f.jpg"/><img"""
    page = rows("page_id int, url string, html string", (1, "http://h/x/", html), (2, "http://h/", None), (3, "http://h/", ""))
    got = [(r.url, r.alt, r.width) for r in N.img_inventory(page, "page_id").collect()]
    assert got == [("http://h/x/a.jpg", "x > y", 3), ("http://h/x/b.jpg", "", 0), ("http://h/x/e&f.jpg", "", 0)]
    assert page.select(F.size(M.image_tags(F.col("html"))).alias("n")).first()["n"] == 3
    listed = N.with_images(page.filter("page_id = 1")).first()["images"]
    assert [i["pos"] for i in listed] == [0, 1, 2]


def test_pages_without_images_have_an_answer(rows):
    asked = rows("name string, manufacturer_sku string, default_code string, effective_manufacturer string, category_name string, page_url string, "
                 "images array<struct<url: string, alt: string, width: int, height: int, context: string>>", ("n", None, "c", "m", None, "u", []))
    row = B.scan_answers(N.prompt_rows(asked).withColumnRenamed("answer", "text")).first()
    assert row.request_text is None and not row.classification.parse_error and not row.classification.page_is_correct_product
