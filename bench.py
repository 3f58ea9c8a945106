"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (input folder), BENCH_CPUS (local cores),
BENCH_QUERIES (comma list, or ``all`` for every registered query),
BENCH_RUNS (timed runs per query, the best counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfsight.plans.registry import all_queries  # noqa: E402
from shelfsight.session import local_session  # noqa: E402


# at least one per part of the model, the heavy ones among them
HEADLINE = """
background_state raster_background bbox_nonwhite canvas_geometry flatten_on_color
crop_translate raster_pixels checkerboard_composite white_to_alpha norm_alnum
effective_manufacturer candidate_counts candidate_order candidate_board
select_single_image select_by_category bulk_approve apply_main_guard
scan_sitemap_urls search_dispatch scan_llm_response settings_typed sink_candidates
search_result_rank sku_url_match discover_pages ssrf_filter_resolved robots_gate
politeness_schedule page_gate download_gate
img_cap img_context prompt_rows choose_page candidate_topn product_state_after_discovery auto_apply
recipe_extract recipe_success_counts recipe_evidence
skip_unchanged normalize_catalog
job_chunk job_progress usage_cost budget_decision job_list_view stream_usage_budget
""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores, "shelfsight-bench")
    spark.read.parquet(f"{folder}/region.parquet").count()
    times: dict[str, float] = {}
    for name, run in all_queries().items():
        if only != ["all"] and name not in only:
            continue
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
