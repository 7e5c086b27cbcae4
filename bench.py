"""Times every registered event query on $BENCH_SF_DIR (sf0.1 by default) with local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times into the noop sink; its time is the least of the three.
"""

from __future__ import annotations

import json
import os
import time

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")

from pyspark.sql import SparkSession

from tidemark.plans.event_queries import QUERIES

HEADLINE = (
    "fixed_window_ctr", "sliding_window_ctr", "custom_window_ctr_bounded", "custom_window_ctr_live", "fixed_window_ctr_panes", "sliding_window_ctr_panes", "latest_publication", "broadcast_enriched", "repeat_emissions",
    "repeater_enriched", "lookup_cache_enriched", "scan_filter_like", "count_records",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(min(times[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
