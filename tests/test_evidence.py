"""Containment with few needles, and the latest rows of a key, against brute force; what the plan of recipe_evidence shuffles."""

import random

import pytest
from pyspark.sql import functions as F

from shelfsight.operators import recipes as C
from shelfsight.operators.substrings import hits_of_few, is_few
from shelfsight.operators.topk import nth_latest_at_most


def test_hits_of_few_equal_brute_force(rows):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé𝄞") for _ in range(n))
    texts = [word(rng.randint(0, 14)) for _ in range(150)] + ["aaaaaaaa", "aaaaaaaa", None]
    needles = sorted({word(rng.randint(1, 7)) for _ in range(60)} | {"aaaa", "a", "aaaaa"})
    df = rows("id int, s string", *enumerate(texts))
    got = sorted((r.id, r.s, r.needle) for r in hits_of_few(df, "s", rows("needle string", *[(n,) for n in needles]), "needle").collect())
    assert got == sorted((i, s, n) for i, s in enumerate(texts) if s is not None for n in needles if n in s)
    assert is_few(df, 153) and not is_few(df, 152)


def test_bound_leaves_the_latest_rows(rows):
    rng = random.Random(5)
    data = [(k, rng.randrange(300), f"id{k}-{i}") for k, n in (("many", 2000), ("some", 40), ("few", 3)) for i in range(n)]
    bounds = {r.k: r._bound for r in nth_latest_at_most(rows("k string, at int, id string", *data), ["k"], "at", "id", 5).collect()}
    for key in ("many", "some"):
        assert bounds[key] is None or sum(k == key and at >= bounds[key] for k, at, _ in data) >= 5
    assert bounds["many"] >= 290 and bounds["few"] is None


CANDIDATES = "candidate_id string, source_page_url string, source_url string, role string, state string, day string"


def _candidates(spark, n=3000):
    rng = random.Random(6)
    data = [(f"c{i}", f"https://www.Brand{rng.randrange(6)}.example.com/product/{rng.randrange(400)}", f"u{i}", "main",
             rng.choice(["approved", "applied", "pending"]), f"2024-0{rng.randint(1, 9)}-{rng.randint(10, 28)}") for i in range(n)]
    data += [("n", "https://www.brand1.example.com/product/1", "u", "main", "approved", None), ("m", None, "u", "main", "applied", "2024-09-28")]
    return spark.createDataFrame(data, CANDIDATES).withColumn("created_at", F.col("day").cast("date"))


@pytest.mark.parametrize("domains", [
    ("brand1", "BRAND2.", "product/77", "www.brand3.example.com", "", "none"), ("BRAND1", "brand1", "ample"), ("no such",), ("product/399",)])
def test_evidence_of_few_domains_equals_that_of_many(spark, rows, domains):
    names, candidates = rows("domain string", *[(d,) for d in domains]), _candidates(spark)
    found = [sorted(map(tuple, C.recipe_evidence(names, candidates, few).collect())) for few in (100, 0)]
    assert found[0] == found[1] and (found[0] or domains[0].startswith(("no", "product/3")))


def test_evidence_moves_no_page_for_few_domains(spark, rows):
    plan = C.recipe_evidence(rows("domain string", ("brand1",), ("brand2",)), _candidates(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_piece" in plan and "hashpartitioning(source_page_url" not in plan and "shared-pieces" not in plan
