"""Headline queries on local[BENCH_CPUS] over BENCH_SF_DIR: one warm-up and the median of three runs each; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    from pyspark.sql import SparkSession

    from quern.plans.catalogue import CATALOGUE

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in CATALOGUE.queries if n.startswith(("bench_q", "tpch_q"))] + ["agg_tpch_q1", "win_rank_family", "win_range_value", "join_self_whole", "except_all", "base_delta_merge"]
    times = {}
    for name in names:
        took = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            CATALOGUE.queries[name](spark, SF).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took[1:]), 4)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    print(json.dumps({"metric": "sum of median seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF.rstrip("/")), "lineitem_rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main()
