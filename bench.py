"""Times the headline queries once each and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from codestrata.plans import catalog
from codestrata.session import build_session

HEADLINE = [
    "classify_layers", "rule_violations", "rule_checks", "architecture_health", "priority_groups",
    "validity_intervals", "snapshot_diffs", "drift_trend", "compare_snapshots",
    "contributors_by_id", "first_touch", "file_history", "commit_index", "modified_edges",
    "function_nodes", "call_relations", "type_counts", "most_called", "change_impact",
    "tfidf_similarity", "evidence", "dependency_decisions", "rank_decisions",
    "git_log_files", "diff_lines", "issue_plan", "search_hits", "route_intents",
    "python_calls", "script_calls", "micro_batch_dedupe",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM paths
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
