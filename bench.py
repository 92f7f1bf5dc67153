"""Time the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS select data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "content_hash", "dedup_report", "text_blocks", "section_tree", "chunk_windows", "chunk_sections",
    "chunk_pages", "bm25_terms", "bm25_topk", "knn_topk", "hierarchical", "hybrid_search",
    "coverage_search", "keyword_overlap", "extract_claims", "find_conflicts", "fit_to_context",
    "resolve_citations", "assign_turns", "previous_answered", "latest_status", "cache_exact",
    "cache_similar", "run_metrics_window",
]


def main() -> None:
    from corpusframe.plans import catalog
    from corpusframe.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(catalog.QUERIES)
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    # Start the JVM code paths and the Python workers once, outside the timings.
    spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count().collect()
    catalog.QUERIES["html_blocks"](spark, folder).limit(1).collect()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline queries, total wall clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
