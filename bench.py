"""Headline queries timed at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "offline_features",
    "serving_features",
    "user_profiles",
    "fraud_labels",
    "train_eval",
    "score_batch",
    "stream_score",
    "worker_stats",
    "run_stats",
    "roc_auc",
    "latest_predictions",
    "recent_transactions",
)
# Queries whose work is one pass over the events, over its last third, or over the usable messages.
PER_EVENT = ("offline_features", "user_profiles", "score_batch", "worker_stats", "run_stats")
PER_LIVE = ("serving_features",)
PER_MESSAGE = ("stream_score",)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from testbed.queries import QUERIES, serving_tables
    from testbed.views import spark_view
    from txnscore.session import prepare

    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(small):
        QUERIES["offline_features"](spark, small).write.format("noop").mode("overwrite").save()
    took, rows_per_sec = {}, {}
    for name in HEADLINE:
        if name == "score_batch":
            # Scoring alone is timed: the model is there already, and so are the stored tables.
            started = time.perf_counter()
            serving_tables(prepare(spark), sf_dir)
            took["serving_tables"] = round(time.perf_counter() - started, 3)
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    live = spark_view(spark, sf_dir, "live").count()
    messages = QUERIES["stream_transactions"](spark, sf_dir).count()
    for names, rows in ((PER_EVENT, events), (PER_LIVE, live), (PER_MESSAGE, messages)):
        rows_per_sec.update({n: round(rows / took[n]) for n in names})
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "rows_per_sec": rows_per_sec,
                "sf": float(os.path.basename(sf_dir).removeprefix("sf") or 0),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
