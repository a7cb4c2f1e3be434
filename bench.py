"""Time the headline queries: one warm-up, then the median of three runs each.

Prints one JSON line. ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores;
query names on the command line (or ``all``) replace the headline list.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tickframe import get_session
from tickframe.plans import QUERIES

HEADLINE = [
    "ohlc_bars",
    "bollinger",
    "pct_change",
    "ema",
    "rsi",
    "macd",
    "ffill_bfill",
    "acf",
    "upsert_latest",
    "page",
    "corr_matrix",
    "minmax_scale",
    "lexicon_sentiment",
    "sentiment_by_symbol",
    "kfold_assign",
    "time_series_split",
    "per_symbol_regression",
    "ar_fit",
    "forecast_steps",
    "market_analysis",
]
RUNS = 3


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "tickframe-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        taken = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_median_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    asked = sys.argv[1:]
    main(list(QUERIES) if asked == ["all"] else asked or HEADLINE)
