"""Times the headline queries and prints one JSON line.

Data: $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
Every query is planned and executed in full (noop sink); starting the workers is
not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "suggest_topk",
    "suggest_batch",
    "similarity_join",
    "similarity_join_blocks",
    "paper_neighbours",
    "chunk_text",
    "extract_identifiers",
    "heuristic_metadata",
    "embed_distinct_texts",
    "dedupe_by_hash",
    "resolve_metadata",
    "sync_plan",
    "apply_sync",
    "search_papers",
    "log_stats",
    "log_windows",
    "debounce_batch",
    "rate_limit_batch",
    "assign_positions",
    "export_bibtex",
    "bundle_export",
    "tree_to_latex",
    "export_markdown",
    "check_constraints",
]


def main() -> None:
    from citespark.session import build_session
    from suite import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # start the Python workers and the scan code before the clock runs
    for warm_up in ("log_stats", "cap_per_paper"):
        QUERIES[warm_up](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
