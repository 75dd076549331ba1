"""Time the registered queries and print one JSON line.

BENCH_SF_DIR  tables to read (default /root/testdata/sf0.1)
BENCH_CPUS    cores of the local session (default: all)
BENCH_QUERIES names to run, separated by commas (default: all)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postlane.plans.catalog import QUERIES  # noqa: E402
from postlane.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "") or str(os.cpu_count())
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = build_session(
        "postlane-bench",
        f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        **{
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "4g"),
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Warm the session and the Python workers, so the first query is not charged for it.
    spark.range(1000).selectExpr("sum(id)").collect()
    QUERIES["html_unescape"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    timings = {}
    for name in names:
        start = time.perf_counter()
        # A sink that computes every column of every row and stores nothing.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
