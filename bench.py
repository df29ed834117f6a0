"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from certus import queries

HEADLINE = [
    "block_histogram",
    "clean_answers",
    "certain_lines",
    "certain_suppliers",
    "certain_boolean",
    "certain_brands",
    "certain_brands_blocks",
    "certain_segments",
    "certain_union",
    "certain_brands_search",
    "range_scalar",
    "range_by_flag",
    "range_by_brand",
    "denial_violations",
    "denial_certain_values",
    "injected_customers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = queries.queries()
    every["block_histogram"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the first job starts the session
    took = {}
    for name in HEADLINE:
        began = time.time()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
