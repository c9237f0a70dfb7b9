"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickerloom.catalog import QUERIES
from tickerloom.schemas import METRIC_COLUMNS
from tickerloom.session import build_session
from tickerloom.sources import adapters as A

HEADLINE = [
    "daily_bars", "technical", "factor_exposure", "rate_sensitivity", "quality_marks", "metrics_known_at_latest", "style_category",
    "comparables", "similar_peers", "health_score", "valuation_reading", "refuge_segments", "zigzag_pivots", "wave_state", "risk_stats",
    "signal_count", "evaluate_portfolios", "select_by_volume", "rank_pct_ties", "upsert_overwrite", "insider_90d", "sentiment_7d",
]


def filled_by_window(spark, sf):
    """The forward fill as windows plus a row number, to compare with the single aggregate of metrics_known_at_latest."""
    w = Window.partitionBy("ticker_usd").orderBy("fecha").rowsBetween(Window.unboundedPreceding, 0)
    newest = F.row_number().over(Window.partitionBy("ticker_usd").orderBy(F.col("fecha").desc()))
    filled = A.metrics(spark, sf).select("ticker_usd", "fecha", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in METRIC_COLUMNS])
    return filled.withColumn("n", newest).filter("n = 1").drop("n")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    builds = {name: QUERIES[name].dataframe for name in HEADLINE} | {"metrics_filled_by_window": filled_by_window}
    if len(sys.argv) > 1:
        builds = {n: b for n, b in builds.items() if n in sys.argv[1:]}
    A.bars(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM and the file cache
    seconds = {}
    for name, build in builds.items():
        t = time.perf_counter()
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
