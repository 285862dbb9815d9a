"""Time the headline queries: one JSON line with seconds per query and their sum."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from catalog.queries import QUERIES

HEADLINE = (
    "price_panel",
    "capped_ffill",
    "volatility_21d",
    "high_low_52w",
    "macro_derived",
    "asof_macro",
    "momentum_z",
    "moving_averages",
    "rsi_14",
    "month_start_leaders",
    "spell_summary",
    "rolling_corr",
    "corr_matrix",
    "reliable_cells",
    "markov_report",
    "backtest_summary",
    "tick_moving_averages",
    "dq_all",
    "enriched_panel",
    "walk_forward",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
