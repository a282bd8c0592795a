"""Times the headline queries and prints one JSON line.

Reads ``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS``.  Each query is run
to a full write into the no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "bars_in_range", "log_returns", "realized_volatility", "moving_averages",
    "exponential_averages", "macd_histogram", "directional_index",
    "technical_features", "wide_universe_returns", "relative_volume_change",
    "normalised_features", "gap_limited_fill", "macro_features",
    "credit_vs_equity", "relative_strength_ratios", "options_expiry_weeks",
    "regime_flags", "clipped_returns", "triple_barrier_classes",
    "full_feature_build", "backfill_run", "classification_dataset_1d",
    "model_dataset", "classification_stats", "prediction_table",
    "classification_metrics", "threshold_grid", "backtest",
    "distribution_profile", "check_duplicate_keys", "upserted_rows",
    "repeated_order_lines",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidemark.queries.catalog import QUERIES
    from tidemark.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark.plans.staging import stored

    # untimed: start the executors, read the inputs once, build the stored tables
    QUERIES["bars_in_range"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    stored(spark, sf_dir)
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times,
        "sf": float(found.group(1)) if found else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
