"""Prints one JSON line: seconds of the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR."""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from millrace import exhibits

HEADLINE = ["mor_no_deletes", "mor_position_deletes", "mor_equality_deletes", "mor_both_deletes", "snapshot_stats", "group_single_partition", "binpack_groups", "plan_small_files", "auto_report"]
WRITING = ["e2e_compact_preserves_rows"]  # makes a table of its own; once, without a warm-up


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        began = time.perf_counter()
        out: DataFrame = exhibits.QUERIES[name](spark, sf)
        out.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds = {}
    for name in HEADLINE:
        once(name)  # warm-up
        seconds[name] = round(statistics.median(once(name) for _ in range(3)), 3)
    seconds |= {name: round(once(name), 3) for name in WRITING}
    print(json.dumps({"metric": "headline queries, sum of medians of 3 after a warm-up", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
