"""Seconds per headline query; prints one JSON line.

The insurance tables are derived from the test tables and written once before the clock starts; each
query is then timed from building its plan to having computed every column of every row.
"""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 16g pyspark-shell")

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registry
from checks.views import load_book
from harborbook.session import RECOMMENDED
from harborbook.sources import TABLES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "rating_master",
    "claim_development",
    "policy_monitoring",
    "coverage_detail",
    "rate_change",
    "customer_month_increments",
    "latest_order_per_customer",
    "order_totals_on_every_line",
    "claims_rolled_up",
    "premium_per_policy_month",
    "orders_beside_the_term_before",
    "newest_crime_scores",
)


def main() -> None:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
    conf = RECOMMENDED | {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": CPUS,
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.all_queries()
    book = load_book(spark, SF_DIR)
    for name in TABLES:
        getattr(book, name)
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    result = {"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
