"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark.plans import QUERIES

HEADLINE = (
    "scan_project_filter markout_stats window_select label_competing_risks day_split_counts raw_top5 toxicity_features market_depth running_resting_size asof_forward_quote post_trade_windows interval_join_lifetime "
    "manifest_expand normalizer_stats quantile_cuts cif_cumsum nll_order_avg ctd_weighted roc_auc implementation_shortfall backtest_summary grid_search_rank bootstrap_ci book_replay_fifo virtual_order_tracking raw_backtest_latency"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["scan_project_filter"](spark, sf).write.format("noop").mode("overwrite").save()  # warm the session
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
