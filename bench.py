"""Headline queries, warm, one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the threads, ``BENCH_RUNS`` the timed runs
per query after one warm-up. Results go to the no-op sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tablecraft.checks import all_queries
from tablecraft.session import build_session

HEADLINE = [
    "flagship_revenue_pivot", "a1_aggregate_back", "a3_sum_mean_median_min_max", "a5_quantile", "t10_recipe", "j1_wide_table",
    "j4_unrelated_tables", "p1_pivot_long", "p3_pivot_wide", "p9_pivot_heat", "w1_step_lag", "w2_latest_by", "w3_page_rows_deep",
    "k1_merge_load", "k5_refresh_wide", "k10_nested_child", "l3_run_summary", "l5_timeline", "l10_run_status", "c1_catalog_diff",
    "c8_similar", "g1_table_hierarchy", "s7_decode_messages", "r2_stream_merge",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
