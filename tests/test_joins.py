"""Sides that grow with the input are never copied to every task, however small the files below them are."""

import os
import re

import pytest

import __spark_entry__ as entry
from shelfsight.operators import rounds as W
from shelfsight.operators.substrings import substring_hits

FOLDER = "/root/testdata/sf0.001"
CANDIDATES = [
    "brand_host_filter", "candidate_metadata", "candidate_rejections", "image_validity", "main_downgrade", "candidate_topn",
    "product_state_after_discovery", "candidate_stats", "brand_fallback_notes", "candidate_gates",
]


def _copied(df) -> list[str]:
    """First keys of the joins that are planned with a copy of one side."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"BroadcastHashJoin \[(?:cast\()?(\w+)#", plan)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")
@pytest.mark.parametrize("name", CANDIDATES)
def test_candidates_meet_by_key(spark, name):
    assert set(_copied(entry.queries()[name](spark, FOLDER))) <= {"category_id"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")
@pytest.mark.parametrize("name", ["job_outcome", "job_progress", "job_close_empty", "job_requeue"])
def test_jobs_meet_their_products_by_key(spark, name):
    assert set(_copied(entry.queries()[name](spark, FOLDER))) <= {"model"}


def test_discovery_meets_by_key(rows):
    image = "struct<url: string, role: string, confidence: double, reasoning: string>"
    looked = rows(f"product_id int, page_pos int, page_url string, outcome string, rendered boolean, recipe_failed boolean, images array<{image}>, match_confidence double",
                  (1, 0, "u", "rejected", True, False, None, 0.1))
    products = rows("product_id int, gallery_enabled boolean, effective_manufacturer string", (1, True, "b"))
    assets = rows("url string, status int, content_type string, n_bytes long, decodable boolean, width int, height int, has_white boolean, studio_answer string",
                  ("x", 200, "image/png", 9999, True, 900, 900, True, None))
    for made in (W.discovery_outcome, W.discovery_log):
        assert not _copied(made(looked, products, assets))


def test_needles_meet_texts_by_key(rows):
    texts, needles = rows("host string, text string", ("h", "xabcdx")), rows("host string, needle string", ("h", "abcd"))
    found = substring_hits(texts, "text", needles, "needle", ["host"])
    assert not _copied(found) and found.count() == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")
def test_pages_are_dealt_out_before_they_are_sorted(spark):
    plan = entry.queries()["choose_page"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(product_id#\w+, page_pos#", plan)
