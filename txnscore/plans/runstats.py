"""Statistics mart: workers, runs, run catalogue and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnscore.functions import report as rx
from txnscore.functions.features import half_up
from txnscore.operators.latest import latest_by_key, merge_fields
from txnscore.plans.latency import (
    LATENCY_FIELDS,
    SMALL_SAMPLE,
    latency_sums,
    mean_ms,
    merged_latency,
    percentiles,
    rounded,
)

GENERATOR = "generator"
WORKER = ["run_id", "worker_id"]

# Defaults of run metadata fields.
RUN_DEFAULTS = {
    "pattern": "constant",
    "target_tps": 0.0,
    "fraud_ratio": 0.1,
    "thread_count": 1,
    "complete": False,
}


def per_second(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, half_up(count / seconds, 2)).otherwise(0.0)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, half_up(part / whole, 4)).otherwise(0.0)


def _configured(events: DataFrame, name: str, fold, default: Column) -> Column:
    """A worker setting, where the events carry it."""
    value = F.coalesce(fold(name), default) if name in events.columns else F.first(default)
    return value.alias(name)


def worker_stats(events: DataFrame) -> DataFrame:
    """One row per (run, worker) from the stats events.

    Generator rows count transactions but never latency. The processing time
    is the span of the worker's events.
    """
    real = events.withColumn(
        "latency_ms", F.when(F.col("worker_id") != GENERATOR, F.col("latency_ms"))
    )
    summed = real.groupBy(*WORKER).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum(F.col("is_fraud").cast("int")).cast("bigint").alias("fraud_count"),
        *latency_sums("latency_ms"),
        F.max("batch_size").alias("batch_size"),
        _configured(events, "parallel_mode", F.bool_or, F.lit(False)),
        _configured(events, "threads", F.max, F.lit(1)),
        F.min("timestamp").alias("start_time"),
        rx.elapsed_seconds(F.min("timestamp"), F.max("timestamp")).alias("processing_time"),
    )
    joined = summed.join(percentiles(real, WORKER, "latency_ms"), WORKER, "left")
    return (
        joined.withColumn("avg_ms", mean_ms(F.col("total_ms"), F.nullif("latency_count", F.lit(0))))
        .withColumns(rounded())
        .withColumns(
            {
                "batch_size": F.coalesce("batch_size", F.lit(1)),
                "throughput": per_second(F.col("transactions"), F.col("processing_time")),
                "fraud_ratio": share(F.col("fraud_count"), F.col("transactions")),
            }
        )
        .drop("total_ms")
    )


def merge_workers(snapshots: DataFrame) -> DataFrame:
    """Snapshots of the same worker from several sources, merged to one row."""
    merged = snapshots.groupBy(*WORKER).agg(
        F.sum("transactions").alias("transactions"),
        F.sum("fraud_count").alias("fraud_count"),
        *merged_latency("latency_count"),
        F.max("batch_size").alias("batch_size"),
        F.bool_or("parallel_mode").alias("parallel_mode"),
        F.max("threads").alias("threads"),
        F.min("start_time").alias("start_time"),
        F.sum(F.col("processing_time").cast("decimal(24,6)")).cast("double").alias("processing_time"),
    )
    return merged.withColumns(rounded()).withColumns(
        {
            "throughput": per_second(F.col("transactions"), F.col("processing_time")),
            "fraud_ratio": share(F.col("fraud_count"), F.col("transactions")),
        }
    )


def own_first(own: DataFrame, stored: DataFrame) -> DataFrame:
    """Own worker rows, plus the stored rows of workers not among them."""
    others = stored.join(own.select(*WORKER), WORKER, "left_anti")
    return own.unionByName(others)


def run_metadata(changes: DataFrame) -> DataFrame:
    """The last whole row of each run, with defaults for missing fields."""
    latest = latest_by_key(changes, "run_id", "seq").drop("seq")
    return latest.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in RUN_DEFAULTS.items()})


def merge_run_changes(changes: DataFrame) -> DataFrame:
    """Field-wise state of each run: every change sets only the fields it carries."""
    return merge_fields(changes, "run_id", "seq")


def runs_table(changes: DataFrame) -> DataFrame:
    merged = merge_run_changes(changes)
    return merged.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in RUN_DEFAULTS.items()})


def combine_workers(workers: DataFrame) -> DataFrame:
    """One row per run over its worker rows; the generator is kept apart."""
    real = F.col("worker_id") != GENERATOR
    masked = workers.withColumn("latency_count", F.when(real, F.col("latency_count")).otherwise(0))
    return masked.groupBy("run_id").agg(
        F.sum(F.when(real, F.col("transactions"))).alias("worker_transactions"),
        F.sum(F.when(real, F.col("fraud_count"))).alias("worker_fraud"),
        F.sum(F.when(~real, F.col("transactions"))).alias("generator_transactions"),
        F.sum(F.when(~real, F.col("fraud_count"))).alias("generator_fraud"),
        *merged_latency("latency_count"),
        F.array_sort(F.collect_set(F.when(real, F.col("worker_id")))).alias("worker_ids"),
    )


def run_stats(runs: DataFrame, workers: DataFrame) -> DataFrame:
    """Runs with their workers' totals.

    Without any worker the generator's counts stand in, then the counts stored
    in the run's own metadata. Worker rows without a run are not reported.
    """
    joined = runs.withColumnsRenamed(
        {"transactions": "stored_transactions", "fraud_count": "stored_fraud", "fraud_ratio": "target_fraud_ratio"}
    ).join(combine_workers(workers), "run_id", "left")
    any_worker = F.coalesce(F.size("worker_ids") > 0, F.lit(False))

    def pick(worker, generator, stored):
        reported = F.when(any_worker, F.col(worker)).otherwise(F.col(generator))
        use_stored = F.coalesce(F.col("stored_transactions") > 0, F.lit(False)) & (
            F.coalesce(F.when(any_worker, F.col("worker_transactions")).otherwise(F.col("generator_transactions")), F.lit(0)) == 0
        )
        return F.coalesce(F.when(use_stored, F.col(stored)).otherwise(reported), F.lit(0))

    counted = joined.withColumns(
        {
            "transactions": pick("worker_transactions", "generator_transactions", "stored_transactions"),
            "fraud_count": pick("worker_fraud", "generator_fraud", "stored_fraud"),
            "duration_seconds": rx.elapsed_seconds(F.col("start_time"), F.col("end_time")),
            "worker_count": F.coalesce(F.size("worker_ids"), F.lit(0)),
            "worker_ids": F.coalesce(F.array_join("worker_ids", ","), F.lit("")),
            "latency_count": F.coalesce("latency_count", F.lit(0)),
            **rounded(),
        }
    )
    return counted.select(
        "run_id", "start_time", "end_time", "pattern", "target_tps", "target_fraud_ratio",
        "thread_count", "complete", "transactions", "fraud_count", *LATENCY_FIELDS,
        "latency_count", "duration_seconds",
        per_second(F.col("transactions"), F.col("duration_seconds")).alias("actual_tps"),
        share(F.col("fraud_count"), F.col("transactions")).alias("fraud_ratio"),
        "worker_count", "worker_ids",
    )


def legacy_run_stats(changes: DataFrame, workers: DataFrame) -> DataFrame:
    """Run summaries with each worker's average standing in for its measurements."""
    real = workers.filter(F.col("worker_id") != GENERATOR)
    measured = real.filter(F.col("latency_count") > 0)
    total = F.sum(F.col("avg_ms").cast("decimal(18,6)") * F.col("latency_count").cast("decimal(19,0)"))
    sums = measured.groupBy("run_id").agg(
        F.sum("latency_count").alias("samples"),
        (total.cast("double") / F.sum("latency_count")).alias("avg_ms"),
    )
    marks = percentiles(measured, ["run_id"], "avg_ms", weight="latency_count")
    few = F.col("samples") < SMALL_SAMPLE
    named = sums.join(marks, "run_id").select(
        "run_id", "avg_ms",
        *[F.when(few, F.col("avg_ms")).otherwise(F.col(p)).alias(p) for p in ("p50_ms", "p95_ms", "p99_ms")],
    )
    heads = real.groupBy("run_id").agg(
        F.sum("transactions").alias("worker_transactions"),
        F.array_sort(F.collect_set("worker_id")).alias("worker_ids"),
    )
    joined = merge_run_changes(changes).join(heads, "run_id", "left").join(named, "run_id", "left")
    zero = ("fraud_ratio", "target_tps", "actual_tps", "duration_seconds")
    return joined.select(
        "run_id", "start_time", "end_time",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in zero],
        F.coalesce("transactions", "worker_transactions", F.lit(0)).alias("transaction_count"),
        *[
            F.coalesce(half_up(F.col(c), 2), F.lit(0.0)).alias(c)
            for c in ("avg_ms", "p50_ms", "p95_ms", "p99_ms")
        ],
        F.coalesce(F.size("worker_ids"), F.lit(0)).alias("workers"),
        F.coalesce(F.array_join("worker_ids", ","), F.lit("")).alias("worker_ids"),
        F.coalesce("pattern", F.lit("unknown")).alias("pattern"),
        F.coalesce("complete", F.lit(False)).alias("complete"),
    )


def feed_stats(feed: DataFrame) -> DataFrame:
    """Counters of the transactions sent per run."""
    sent = feed.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum(F.col("is_fraud").cast("bigint")).alias("fraud_count"),
        (F.max("timestamp") - F.min("timestamp")).cast("double").alias("duration_seconds"),
    )
    n, took = F.col("transactions"), F.col("duration_seconds")
    return sent.withColumns(
        {
            "fraud_percentage": half_up(F.col("fraud_count") * 100.0 / n, 4),
            "actual_tps": F.when(took > 0, half_up(n / took, 6)).otherwise(0.0),
        }
    )


def list_runs(changes: DataFrame, limit: int = 10) -> DataFrame:
    """Newest runs first (a top-k report) from the run change log."""
    return (
        merge_run_changes(changes)
        .orderBy(F.col("start_time").desc_nulls_last(), "run_id")
        .limit(limit)
        .select(
            "run_id", "start_time", "end_time",
            rx.elapsed_seconds(F.col("start_time"), F.col("end_time")).alias("duration"),
            F.coalesce("pattern", F.lit("unknown")).alias("pattern"),
            F.coalesce("target_tps", F.lit(0.0)).alias("target_tps"),
            F.coalesce("complete", F.lit(False)).alias("complete"),
        )
    )


def run_ids(keys: DataFrame, key: str, prefix: str, limit: int = 10) -> DataFrame:
    """Highest run ids among storage keys, without worker rows (a top-k report)."""
    ident = rx.key_part(F.col(key))
    return (
        keys.filter(F.col(key).startswith(f"{prefix}run-"))
        .select(ident.alias("run_id"))
        .filter(~F.col("run_id").contains("worker"))
        .distinct()
        .orderBy(F.col("run_id").desc())
        .limit(limit)
    )


def base_run_keys(keys: DataFrame, key: str) -> DataFrame:
    """Keys of runs themselves: exactly three ``:``-separated parts."""
    return keys.filter(F.size(F.split(key, ":")) == 3)


def latest_run_stats(changes: DataFrame, workers: DataFrame) -> DataFrame:
    """Statistics of the most recently started run.

    The one run is picked first, so only its worker rows are aggregated.
    """
    mine = F.col("run_id") == list_runs(changes, 1).select("run_id").scalar()
    return run_stats(runs_table(changes.filter(mine)), workers.filter(mine))


def run_report(stats: DataFrame) -> DataFrame:
    """The figures of a run summary as text columns and band names."""
    return stats.select(
        "run_id",
        rx.run_status(F.col("complete")).alias("status"),
        rx.date_text(F.col("start_time")).alias("started"),
        rx.date_text(F.col("end_time")).alias("ended"),
        rx.duration_text(F.col("duration_seconds")).alias("duration"),
        "pattern", "target_tps", "actual_tps",
        rx.tps_band(F.col("actual_tps")).alias("tps_band"),
        "transactions", "fraud_count",
        half_up(F.col("fraud_ratio") * 100.0, 1).alias("fraud_percent"),
        "worker_count",
        ((F.col("worker_count") == 0) & (F.col("transactions") > 0)).alias("generator_only"),
        *[rx.latency_band(F.col(c)).alias(f"{c[:-3]}_band") for c in LATENCY_FIELDS],
    )


def worker_report(workers: DataFrame) -> DataFrame:
    """The figures of a worker summary."""
    return workers.select(
        *WORKER,
        rx.worker_mode(F.col("parallel_mode")).alias("mode"),
        "batch_size", "threads",
        rx.date_text(F.col("start_time")).alias("started"),
        rx.duration_text(F.col("processing_time")).alias("processing"),
        "transactions", "throughput",
        rx.tps_band(F.col("throughput")).alias("tps_band"),
        "fraud_count",
        half_up(F.col("fraud_ratio") * 100.0, 1).alias("fraud_percent"),
        *[rx.latency_band(F.col(c)).alias(f"{c[:-3]}_band") for c in LATENCY_FIELDS],
    )


def run_stats_json(stats: DataFrame, workers: DataFrame, pretty: bool = False) -> DataFrame:
    """One JSON document per run, with a map of its workers (bounded by the cluster)."""
    latency = lambda: F.struct(*LATENCY_FIELDS, F.col("latency_count").alias("count"))
    per_worker = (
        workers.filter(F.col("worker_id") != GENERATOR)
        .withColumn("start_time", rx.iso_text(F.col("start_time")))
        .select(
            *WORKER,
            F.struct(
                "worker_id", "run_id", "transactions", "fraud_count", latency().alias("latency"),
                "batch_size", "parallel_mode", "threads", "start_time", "processing_time",
            ).alias("worker"),
        )
        .groupBy("run_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("worker_id", "worker")))).alias("workers"))
    )
    document = F.struct(
        "run_id",
        F.struct(
            "run_id",
            rx.iso_text(F.col("start_time")).alias("start_time"),
            rx.iso_text(F.col("end_time")).alias("end_time"),
            "pattern", "target_tps", F.col("target_fraud_ratio").alias("fraud_ratio"), "thread_count", "complete",
        ).alias("metadata"),
        "workers",
        "transactions", "fraud_count", "fraud_ratio", "duration_seconds", "actual_tps",
        latency().alias("latency"),
        "worker_count",
        F.filter(F.split("worker_ids", ","), lambda w: w != "").alias("worker_ids"),
    )
    return stats.join(per_worker, "run_id", "left").select(
        "run_id", F.to_json(document, {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("document")
    )
