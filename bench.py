"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local threads. Inputs that every query
shares (the bar and context tables) are built once and timed as `build_inputs`. Each query then runs
twice; the second run is reported, the first is listed under `first_run`.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from quotemill.plans import inputs  # noqa: E402
from quotemill.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "src6_line_bars",
    "src6_brand_bars",
    "ind30_all_indicators",
    "sigd_all_rules_long",
    "pos1_timed_positions",
    "met10_yearly",
    "met11_run_summary",
    "swp1_holding_sweep",
    "swp4_wide_buy_search",
    "brd1_latest_scan",
    "brd3_rule_board",
    "brd4_symbol_board",
    "str1_stream_bars",
)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark.range(1000))
    queries = {"build_inputs": timed(lambda: inputs.context(spark, folder))}
    first = {}
    for name in HEADLINE:
        first[name] = timed(lambda: run(QUERIES[name](spark, folder)))
        queries[name] = timed(lambda: run(QUERIES[name](spark, folder)))
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "first_run": first,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
