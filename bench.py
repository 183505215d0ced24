"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from claimweave.plans import catalog
from claimweave.session import release

HEADLINE = [
    "route_papers",
    "chunks",
    "reply_verdicts",
    "verdict_counts",
    "edge_verdicts",
    "merge_exact",
    "consolidation_stats",
    "anchor_match",
    "node_objects",
    "relation_objects",
    "documents",
    "conformance",
    "edge_status",
    "components",
    "reassembled",
    "progress_stalls",
    "run_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("claimweave-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    queries["route_papers"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up, not measured
    seconds = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    sf = re.search(r"sf([0-9.]+)/?$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf.group(1)) if sf else sf_dir,
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
