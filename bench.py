"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (table folder), ``BENCH_CPUS`` (local cores),
``BENCH_QUERIES`` (comma-separated names, default the headline set).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from provisio.plans import catalog
from provisio.session import local_session

HEADLINE = [
    # hierarchy and legal-effect state
    "allocate_tokens", "next_sibling", "scaffold_chain", "refresh_document_status", "refresh_hierarchy_status", "chunk_effective",
    # corpus building
    "upsert_chunks", "graph_mirror", "effective_date", "internal_refs", "path_relations", "chunk_by_heading", "anchor_spans", "html_to_blocks",
    # retrieval
    "knn_all_vectors", "fts_short_queries", "hybrid_search", "search_in_docs", "expand_seeds_path", "order_for_prompt",
    # contract rules, report, conversations
    "red_flag_hits", "merge_by_clause", "validate_preamble", "ground_citations", "severity_summary", "rolling_memory", "stream_findings_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, "provisio-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)  # the first run warms up
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(found.group(1)) if found else None,
    }))


if __name__ == "__main__":
    main()
