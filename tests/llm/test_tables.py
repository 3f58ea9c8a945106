"""Quality rules, source mixing and WARC transactions: small tables against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfsight.llm.mixing import mix_to_weights, repeated
from shelfsight.llm.quality_rules import fit_rules, score_quality, text_statistics
from shelfsight.llm.warc import assemble_captures, capture_pages, read_records, write_captures

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", "  \n\t ", "one", "a b c a b c", "x y x y x y x", "line one\nline one\n\n line one\nother\n",
    "# a #b $c\n|d| <e> &f *g %h", "É ß 日本 語  x\x0bq\x0c", "w " * 5000, "tie tie tie\ntie tie tie",
]


def _stats(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


def test_statistics_equal_plain_loops(rows):
    df = rows("doc_id int, text string, n_words string", *[(i, t, "clash") for i, t in enumerate(TEXTS)])
    got = {r["doc_id"]: r for r in text_statistics(df).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == _stats(text), text


def test_quality_verdicts(spark, rows):
    rng = random.Random(1)
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(90)) + "." for _ in range(40)]
    junk = [" ".join(f"{chr(97 + (i + 3 * j) % 26)}$$$ #{j}%%" for j in range(80)) for i in range(8)]
    data = [(i, t) for i, t in enumerate([*clean, *junk, None, "short text"])]
    out = {r["doc_id"]: r for r in score_quality(rows("doc_id int, text string", *data)).collect()}
    assert len(out) == len(data)
    assert all(out[i]["kept"] for i in range(40))
    assert not any(out[i]["kept"] for i in range(40, 50))
    assert out[48]["base_failed"] and out[49]["base_failed"] and not out[40]["base_failed"]
    assert score_quality(rows("doc_id int, text string")).count() == 0
    votes = spark.createDataFrame([], "a int, b int")
    assert fit_rules(votes, ["a", "b"]).prior == 0.85


def _mix_by_hand(sizes, weights, epochs):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            break
        level = (total - sum(epochs * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > epochs * sizes[s]}
        if not over:
            break
        capped |= over
    return {s: epochs * sizes[s] if s in capped else weight[s] * level for s in names}


def test_mix_reaches_targets(rows):
    data = []
    for s, (name, n) in enumerate([("a", 40), ("b", 400), (None, 30), ("é", 3), ("z", 1)]):
        data += [(1000 * s + i, "w " * (1 + (i * 7) % 50), name, 1.0) for i in range(n)]
    data += [(9000, None, "a", 0.0), (9001, "", "empty", 0.0), (5, "w w w", "a", 1.0), (5, "w w w", "a", 1.0), (None, "w w", "b", 1.0)]
    df = rows("doc_id int, text string, source string, target double", *data)
    out = mix_to_weights(df, [5, 2, 1], seed=4).collect()
    again = mix_to_weights(df.repartition(7), [5, 2, 1], seed=4, keep_text=False).collect()
    assert sorted(map(str, ((r["doc_id"], r["taken"]) for r in out))) == sorted(map(str, ((r["doc_id"], r["taken"]) for r in again)))
    assert len(out) == len(data)
    sizes = Counter()
    for _, text, source, _ in data:
        sizes[source] += len((text or "").split())
    want = _mix_by_hand(sizes, [5, 2, 1], 3.0)
    taken = Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 25 + 1e-6, source
    mix = repeated(mix_to_weights(df, [5, 2, 1], seed=4))
    assert mix.count() == sum(r["copies"] for r in out)
    assert mix_to_weights(rows("doc_id int, text string, source string"), [1]).count() == 0


PAGES = [
    (1, "http://a/x", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (3, None, None), (4, "http://c", ""),
    (5, "http://d/\r\nWARC/1.1 x", "body\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nContent-Length: 3\r\n\r\n"),
    (6, "http://é/ü", "日本   \x0b ß" * 50), (None, "http://n", "<p>same</p>"), (7, "http://e", "\r\n\r\n"), (7, "http://e", "\r\n\r\n"),
    (8, "http://f", "x" * 300_000),
]


def test_captures_round_trip(spark, rows, tmp_path):
    df = rows("page_id long, url string, html string, record_type int", *[(*p, 0) for p in PAGES]).repartition(3)
    path = str(tmp_path / "warc")
    write_captures(df, path)
    got = assemble_captures(read_records(spark, path)).collect()
    assert len(got) == len(PAGES)
    first = {}
    for page, _, html in PAGES:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    seen = []
    for r in got:
        assert len(r["requests"]) == len(r["metadata"]) == 1
        fields = r["metadata"][0]["fields"]
        page = int(fields["pageId"]) if "pageId" in fields else None
        html = next(h for p, _, h in PAGES if p == page) or ""
        seen.append(page)
        assert int(fields["payloadBytes"]) == len(html.encode())
        is_first = first[html] == page
        assert r["response"]["record_type"] == ("response" if is_first else "revisit")
        assert r["response"]["payload"] == (html.encode() if is_first else b"")
        assert fields.get("refersToPage") == (None if is_first else str(first[html]))
    assert sorted(map(str, seen)) == sorted(str(p[0]) for p in PAGES)
    assert capture_pages(df.filter("false")).count() == 0


def test_large_payloads_only_are_revisits(rows):
    got = capture_pages(rows("page_id long, url string, html string", *PAGES), min_bytes=100).collect()
    kinds = {r["metadata"][0]["fields"].get("pageId"): r["response"]["record_type"] for r in got}
    assert set(kinds.values()) == {"response"}


def test_orphans_and_lone_records(rows):
    schema = ("record_id string, record_type string, concurrent_to string, warc_date string, target_uri string, "
              "payload_digest string, headers map<string,string>, fields map<string,string>, payload binary")
    made = [
        ("r1", "response", None, "d", "u", "X", {}, {}, b"a"), ("q1", "request", "r1", "d", "u", None, {}, {}, b"GET"),
        ("m2", "metadata", "gone", "d", "u", None, {}, {"k": "v"}, b"k: v"), ("i", "warcinfo", None, "d", None, None, {}, {}, b""),
    ]
    got = {r["capture_id"]: r for r in assemble_captures(rows(schema, *made)).collect()}
    assert set(got) == {"r1", "gone", "i"}
    assert got["r1"]["requests"][0]["block"] == "GET" and got["r1"]["metadata"] == []
    assert got["gone"]["response"] is None and got["gone"]["metadata"][0]["fields"] == {"k": "v"}


def test_base32_digest_of_a_known_payload(rows):
    from shelfsight.llm.warc import base32_sha1

    got = rows("x string", ("",), ("abc",)).select(base32_sha1(F.encode("x", "UTF-8")).alias("d")).collect()
    assert [r["d"] for r in got] == ["3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ", "VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5"]
