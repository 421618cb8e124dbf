"""Times the headline queries: median of two warm runs each, written to a sink that keeps nothing."""

from __future__ import annotations

import json
import os
import statistics
import time

from codeloom.plans import QUERIES
from codeloom.session import local_session
from codeloom.sources.tables import SPLITS

HEADLINE = [
    "s1_extract_prose_blocks", "s1_extract_code_blocks", "scan_pages", "f1_resolve_names", "f8_language_by_content",
    "d1_exact_groups", "d3_latest", "d7_resolved_files", "j6_d5_near_duplicate_members", "j4_incremental_merge", "a9_file_metrics",
    "a5_overview", "q3_relevance", "t1_search_by_relevance", "a20_diff_statistics", "v6_changed_line_sets", "j7_version_as_of",
    "l10_all_findings", "a10_dependencies", "st4_live_merge",
]
RUNS = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores))
    spark.conf.set(SPLITS, cores)  # the test tables are stored as one row group each
    seconds: dict[str, float] = {}
    for name in [n for n in HEADLINE if n in QUERIES]:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
