"""The pipeline on the smallest sample, stage by stage against plain Python; the corpus queries' shape and SQL."""

import os
import re
from collections import Counter

import pytest
import xxhash

import __spark_entry__ as entry
import corpus_pipeline as pipe
from tools.check import canon

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")


def _norm(text):
    return [w for w in ("".join(c for c in t if c.isalnum()) for t in (text or "").lower().split()) if w]


def _print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i: i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, results = docs.columns, [docs]
    for _, stage in pipe.STAGES:
        results.append(stage(spark, results[-1], FOLDER).cache())
    assert all(r.columns == columns for r in results[1:-1])
    rows = [[r.asDict() for r in df.collect()] for df in results]

    letters = [r for r in rows[0] if re.search(r"[^\W\d_]", r["text"] or "")]
    assert {r["doc_id"] for r in rows[1]} <= {r["doc_id"] for r in letters}
    assert len(rows[1]) >= 0.98 * len(letters)

    prints = {r["doc_id"]: _print(r["text"]) for r in rows[1]}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"] for r in rows[2]} == {find(i) for i in prints}

    items = [_norm(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def leaks(words):
        there = set(words)
        for item in items:
            w = min(12, len(item))
            if len(item) < 8 or len(there & set(item)) < 5:
                continue
            for i in range(len(words) - w + 1):
                for j in range(len(item) - w + 1):
                    if sum(x == y for x, y in zip(words[i: i + w], item[j: j + w])) >= 0.8 * w - 1e-9:
                        return True
        return False

    sure = {r["doc_id"] for r in rows[2] if any(" ".join(x) in " ".join(_norm(r["text"])) for x in items if len(x) >= 8)}
    kept = {r["doc_id"] for r in rows[3]}
    gone = {r["doc_id"]: r for r in rows[2] if r["doc_id"] not in kept}
    assert sure <= set(gone) and all(leaks(_norm(r["text"])) for r in gone.values())

    before = {r["doc_id"]: r for r in rows[3]}
    token = re.compile(r"token = \"[0-9a-f]{40}")
    for r in rows[4]:
        old = before[r["doc_id"]]
        assert not token.search(r["text"]) and (r["text"] == old["text"]) == ("[SECRET]" not in r["text"])
        if r["text"] == old["text"]:
            assert r == old
        else:
            assert r["n_chars"] == len(r["text"])
    assert len(rows[4]) == len(rows[3])

    sizes = Counter()
    for r in rows[4]:
        sizes[r["source"]] += len(r["text"].split())
    taken = Counter()
    for r in rows[5]:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and 1 <= r["copies"] <= 3
    largest = max(r["size"] for r in rows[5])
    for r in rows[5]:
        assert abs(taken[r["source"]] - r["target"]) <= largest


def test_corpus_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


@pytest.mark.parametrize("name", ["op4_warc_transactions", "op5_mix_sources"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    got = sorted(tuple(canon(r[c]) for c in sorted(names)) for r in df.collect())
    assert sorted(df.columns) == sorted(names)
    assert got == sorted(tuple(canon(r[names.index(c)]) for c in sorted(names)) for r in res.fetchall())
