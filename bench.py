"""Wall time of the registered queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8) and
``BENCH_QUERIES`` (comma-separated, default all) select the run. Every query is
run to its last row into a sink that keeps nothing. A short warm-up starts the
JVM and the Python workers and is not counted.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from workloads.queries import QUERIES

WARM_UP = ["health_score", "fuzzy_wratio", "value_counts_lines"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        # Plans are built from many small column expressions; their call sites are not needed.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in WARM_UP:
        run(name)
    seconds: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    result = {
        "metric": "total wall time of the registered queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
