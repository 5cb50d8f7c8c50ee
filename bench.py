"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names to run instead of the headline list
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from flowlens.plans.catalog import QUERIES  # noqa: E402
from flowlens.session import build_session  # noqa: E402

HEADLINE = [
    "recent_alerts", "alert_time_range", "alert_search", "alert_page_deep", "alert_statistics", "alert_timeline",
    "alert_metrics", "top_attacks", "activity_series", "severity_trend", "session_statistics", "traffic_totals",
    "sessions", "delete_old_alerts", "enrich", "detection_summary",
    "clean_zero", "clean_mean", "deduplicate", "missing_profile", "map_labels", "class_weights_inverse",
    "attach_weights", "harmonize", "column_summary", "index_categories", "standardize_features",
    "hash_split", "stratified_split", "rebalance_missing", "flows_to_json", "parse_flow_json",
    "confusion_normalized", "classification_report", "auc_roc", "auc_pr",
    "train_lr", "train_rf_binary", "train_gbt_binary", "train_rf_multiclass",
    "preprocess", "stream_alerts", "stream_timeline", "batch_detect",
]

# Query to (input table, passes of it in the input).
RATED = {
    "enrich": ("events", 1), "stream_alerts": ("events", 1), "parse_flow_json": ("events", 1),
    "flows_to_json": ("lineitem", 1), "clean_zero": ("lineitem", 1), "deduplicate": ("lineitem", 2),
    "preprocess": ("lineitem", 2), "stratified_split": ("lineitem", 1), "auc_roc": ("lineitem", 1),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["traffic_totals"](spark, sf_dir).collect()  # start the JVM's and Parquet's code before timing
    seconds = {}
    for name in names:
        start = time.perf_counter()
        # The noop sink computes every row and column and keeps none.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    # Input rows per second of the queries that pass over a whole table.
    sizes = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet").count() for name in ("events", "lineitem")}
    rates = {name: round(factor * sizes[table] / seconds[name])
             for name, (table, factor) in RATED.items() if name in seconds}
    print(json.dumps({
        "metric": "total wall-clock of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "rows_per_sec": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
