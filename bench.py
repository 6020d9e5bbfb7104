"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.

first_N is the first query over a tree of N source files: they are listed, read, parsed and their smells counted.
"""

import json
import os
import shutil
import tempfile
import time

from quarry.operators import facts
from quarry.plans import catalog, source
from quarry.session import session
from quarry.sources import files

HEADLINE = [
    "hotspots", "counter_struct", "smell_counts", "line_scan", "debt_markers", "carry_forward", "health_score", "impact_bucket", "nearest_rank", "range_semi", "content_hash", "degree_metrics", "trace_bfs", "simple_paths", "knn", "hybrid",
    "debounce_sessions", "tumbling",
]
TREES = [30, 300, 1000]


def first_query(spark, rows: list, n: int) -> float:
    """Seconds of the first query over n files on the local disk; *rows* have path and text."""
    root = tempfile.mkdtemp(prefix="quarry-bench-")
    for r in rows[:n]:
        path = os.path.join(root, r.path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(r.text * 5)
    began = time.perf_counter()
    facts.smells(files.nodes(files.source_files(spark, root))).groupBy("kind").count().collect()
    took = time.perf_counter() - began
    shutil.rmtree(root)
    return took


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_driver_memory="4g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    rows = source.code_files(spark, sf_dir).limit(max(TREES)).collect()
    for n in TREES:
        took[f"first_{n}"] = round(first_query(spark, rows, n), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
