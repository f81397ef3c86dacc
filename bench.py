"""Time the headline queries; prints one JSON line.

Each query runs twice and the second run counts, so start-up and code generation of a
fresh JVM are left out. Every run reads its tables again; nothing is cached.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from jabcheck.checks.queries import QUERIES

HEADLINE = (
    "table1_overall_flags",
    "table2_campaign_flags",
    "table3_product_flags",
    "table4_interval_context",
    "table5_campaign_transition",
    "table6_product_transition",
    "table_flu_sources",
    "table_date_agreement",
    "upset_intersections",
    "extract_events",
    "same_day_pattern",
    "same_day_flags",
    "active_flag_any",
    "flu_source_summary",
    "inject_faults",
    "inject_intervals",
    "age_shift",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
    line = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
