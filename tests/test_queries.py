"""Registered queries against their SQL, and streams against batch, on the smallest sample."""

import os

import pytest

import __spark_entry__ as entry
from shelfsight.plans.registry import all_queries
from tools.check import canon
from verification.oracle import all_oracles

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "background_state", "effective_manufacturer", "select_by_category", "discover_pages", "candidate_topn",
    "recipe_extract", "normalize_catalog", "job_progress", "stream_usage_budget", "stream_job_ticks",
    "scan_images", "sink_product_updates", "recipe_ingest", "img_inventory", "prompt_rows", "politeness_schedule", "sku_url_match",
    "recipe_evidence", "apply_main_state", "sitemap_expand",
]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    import duckdb

    from shelfsight.plans.derived_sql import BASE_TABLES

    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(canon(r[c]) for c in sorted(names)) for r in df.collect())
    want = sorted(tuple(canon(r[names.index(c)]) for c in sorted(names)) for r in res.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_key_is_registered_twice():
    assert len(entry.queries()) > 110
