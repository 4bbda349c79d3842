"""End-to-end jobs over one deployment folder (``root``).

Layout below ``root``: ``history`` (all usable transactions), ``rejected_history``
(deliveries that could not be used, with the reason), ``profiles``,
``serving_history`` (one row per user and second), ``training`` (labelled
features), ``models`` and ``model_registry``, ``runs`` and ``workers`` (logs), and
``scored``, the one table of the scoring stream: predictions, results, events, dead
letters and batch figures are views of its committed batches.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txnscore.config import DEFAULTS, Settings
from txnscore.ml.model import train
from txnscore.ml.registry import ModelRegistry
from txnscore.operators.latest import latest_by_key
from txnscore.plans import results, runstats
from txnscore.plans.history import load_history, offline_features, rejected_history
from txnscore.plans.labels import add_fraud_labels
from txnscore.plans.profiles import user_profiles
from txnscore.plans.serving import compact_history
from txnscore.session import fresh_path, materialize
from txnscore.session import prepare as prepare_session
from txnscore.sources import readers, sinks
from txnscore.sources.runlog import RunLog, WorkerLog
from txnscore.sources.stored import read_by_user, save_by_user
from txnscore.streaming import score as scoring
from txnscore.streaming.score import ScoringJob, scored_table
from txnscore.streaming.tail import drain, of_run


def load(
    spark: SparkSession, raw: DataFrame, root: str, seq: str | Sequence[str], settings: Settings = DEFAULTS
) -> None:
    """Raw transactions to the history, profile and serving tables.

    ``seq`` orders the writes of one transaction id. History files are ranges of
    (user, time), so a lookup by user reads few of them and a hot user still
    spreads over several. Profiles and serving history are partitioned by a hash of
    the user; within a partition the serving files are ranges of time.
    """
    prepare_session(spark)
    order = [seq] if isinstance(seq, str) else list(seq)
    sinks.save_table(rejected_history(raw), f"{root}/rejected_history")
    ready = load_history(raw, order).drop(*order)
    sinks.save_table(
        ready.repartitionByRange("user_id", "timestamp").sortWithinPartitions("user_id", "timestamp"),
        f"{root}/history",
    )
    history = spark.read.parquet(f"{root}/history")
    save_serving(user_profiles(history), compact_history(history), root, settings)


def save_serving(profiles: DataFrame, compact: DataFrame, root: str, settings: Settings = DEFAULTS) -> None:
    """The two stored tables of scoring, partitioned by the hash of the user."""
    save_by_user(profiles, f"{root}/profiles", settings.user_buckets)
    save_by_user(compact, f"{root}/serving_history", settings.user_buckets, within="timestamp")


def build_training(spark: SparkSession, root: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Features and labels of the whole history, as the ``training`` table."""
    prepare_session(spark)
    features = offline_features(spark.read.parquet(f"{root}/history"))
    labelled = add_fraud_labels(materialize(features, "features"), settings.fraud_label_ratio, settings.random_state)
    sinks.save_table(labelled, f"{root}/training")
    return spark.read.parquet(f"{root}/training")


def train_model(
    spark: SparkSession, root: str, settings: Settings = DEFAULTS, description: str = "Fraud detection model"
) -> tuple[str, DataFrame]:
    """Train on the ``training`` table, register the model; returns version and metrics."""
    trained = train(spark.read.parquet(f"{root}/training"), settings)
    version = ModelRegistry(spark, root, settings.model_name).save(trained.model, description, trained.metrics)
    return version, trained.metrics


def prepare(
    spark: SparkSession, raw_path: str, root: str, settings: Settings = DEFAULTS, multiline: bool = True
) -> tuple[str, DataFrame]:
    """From raw JSON to a registered model."""
    raw = readers.read_raw_json(spark, raw_path, multiline, arrival=True)
    load(spark, raw, root, readers.ARRIVAL, settings)
    build_training(spark, root, settings)
    return train_model(spark, root, settings)


def scoring_job(
    spark: SparkSession,
    root: str,
    version: str | None = None,
    worker_id: str = "spark",
    settings: Settings = DEFAULTS,
) -> ScoringJob:
    return ScoringJob(
        ModelRegistry(spark, root, settings.model_name).load(version),
        read_by_user(spark, f"{root}/serving_history"),
        read_by_user(spark, f"{root}/profiles"),
        root,
        worker_id,
        settings,
    )


def start_worker(
    spark: SparkSession,
    root: str,
    feed: str,
    version: str | None = None,
    worker_id: str = "spark",
    settings: Settings = DEFAULTS,
    available_now: bool = False,
    files_per_trigger: int = 8,
) -> StreamingQuery:
    """Score the message files below ``feed`` as they arrive."""
    job = scoring_job(prepare_session(spark), root, version, worker_id, settings)
    return job.start(readers.stream_messages(spark, feed, files_per_trigger), available_now)


def predictions(spark: SparkSession, root: str) -> DataFrame:
    """Every scored transaction as often as it was delivered; ``results.latest_predictions`` keeps the last."""
    return scoring.predictions(scored_table(prepare_session(spark), root).rows("predictions"))


def result_messages(spark: SparkSession, root: str) -> DataFrame:
    return scoring.result_messages(scoring.predictions(scored_table(prepare_session(spark), root).rows("results")))


def stats_events(spark: SparkSession, root: str) -> DataFrame:
    return scoring.stats_events(scoring.predictions(scored_table(prepare_session(spark), root).rows("stats_events")))


def dead_letters(spark: SparkSession, root: str) -> DataFrame:
    return scoring.dead_messages(scored_table(prepare_session(spark), root).rows("dead_letters"))


def batch_stats(spark: SparkSession, root: str) -> DataFrame:
    return scoring.batch_figures(scored_table(prepare_session(spark), root).commits("batch_stats"))


def stream_progress(spark: SparkSession, root: str) -> DataFrame:
    return scoring.progress(scored_table(prepare_session(spark), root).commits())


def worker_stats(spark: SparkSession, root: str) -> DataFrame:
    return runstats.worker_stats(stats_events(spark, root))


def run_stats(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """Statistics of one run, by default of the newest; empty if the run is unknown."""
    changes, workers = RunLog(spark, f"{root}/runs").changes(), worker_stats(spark, root)
    if run_id is None:
        return runstats.latest_run_stats(changes, workers)
    wanted = F.col("run_id") == run_id
    return runstats.run_stats(runstats.runs_table(changes.filter(wanted)), workers.filter(wanted))


def list_runs(spark: SparkSession, root: str, limit: int = 10) -> DataFrame:
    return runstats.list_runs(RunLog(spark, f"{root}/runs").changes(), limit)


def export_run_stats(spark: SparkSession, root: str, path: str, run_id: str | None = None) -> None:
    documents = runstats.run_stats_json(run_stats(spark, root, run_id), worker_stats(spark, root))
    sinks.export_json(documents, path)


def run_stats_text(spark: SparkSession, root: str, run_id: str) -> str | None:
    """The indented JSON document of one run, None if the run is unknown."""
    mine = F.col("run_id") == run_id
    documents = runstats.run_stats_json(
        run_stats(spark, root, run_id), worker_stats(spark, root).filter(mine), pretty=True
    )
    found = documents.first()
    return found and found["document"]


def latest_results(spark: SparkSession, root: str, limit: int = 10, run_id: str | None = None) -> DataFrame:
    """The newest results; of the stored batches only the newest are read, until there are enough."""
    table = scored_table(prepare_session(spark), root)
    newest = table.newest(lambda rows: of_run(scoring.predictions(rows), run_id), limit, "results")
    return results.latest_results(scoring.results(newest), ["processed_at", "batch_id", "transaction_id"], limit)


def follow_results(spark: SparkSession, root: str, out: str, checkpoint: str, run_id: str | None = None) -> DataFrame:
    """Results committed since the last call go to ``out``, each once; returns all of them."""
    view = lambda rows: scoring.results(scoring.predictions(rows))
    return drain(scored_table(prepare_session(spark), root), view, out, checkpoint, run_id, name="results")


def show_results(spark: SparkSession, root: str, run_id: str | None = None) -> StreamingQuery:
    """Print results as their batches are committed."""
    show = lambda rows, _: of_run(scoring.results(scoring.predictions(rows)), run_id).show(truncate=False)
    return scored_table(spark, root).follow(show, fresh_path(spark, "live"), "results", available_now=False)


def snapshot_workers(spark: SparkSession, root: str) -> None:
    """Keep the worker statistics as they are now."""
    WorkerLog(spark, f"{root}/workers").save(worker_stats(spark, root))


def stored_workers(spark: SparkSession, root: str) -> DataFrame:
    """The newest snapshot of every run and worker."""
    return WorkerLog(prepare_session(spark), f"{root}/workers").workers()


def _micros(spark: SparkSession, at: Column) -> int:
    return spark.range(1).select(F.unix_micros(at.cast("timestamp"))).first()[0]


def expire(spark: SparkSession, root: str, now: Column, settings: Settings = DEFAULTS) -> int:
    """Hide the stats events of batches committed longer than the retention before ``now``.

    A mark is moved, so nothing is rewritten and a running stream is not disturbed. Days that
    no view shows any more are removed as a whole. Returns the mark, in microseconds.
    """
    table = scored_table(prepare_session(spark), root)
    table.set_mark("stats_events", _micros(spark, now) - settings.retention_hours * 3_600_000_000)
    table.sweep(scoring.VIEWS)
    return table.mark("stats_events")


def expire_runs(spark: SparkSession, root: str, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Drop the runs whose last change is older than the retention; returns their ids.

    The log goes on with a new version: changes that arrive meanwhile are in it.
    """
    log = RunLog(prepare_session(spark), f"{root}/runs").log
    last = log.rows().groupBy("run_id").agg(F.timestamp_micros(F.max("seq")).alias("changed"))
    kept = results.retained(last, "changed", now, settings.retention_hours).select("run_id")
    gone = materialize(last.select("run_id").join(kept, "run_id", "left_anti"), "expired-runs")
    log.rewrite(lambda changes: changes.join(gone, "run_id", "left_anti"))
    log.vacuum()
    return gone


def expire_workers(spark: SparkSession, root: str, now: Column, settings: Settings = DEFAULTS) -> None:
    """Drop the worker snapshots older than the retention, and those that newer ones replace."""
    log = WorkerLog(prepare_session(spark), f"{root}/workers").log
    keep = lambda rows: results.retained(latest_by_key(rows, list(runstats.WORKER), "saved_at"), "saved_at", now, settings.retention_hours)
    log.rewrite(keep)
    log.vacuum()


# The views that can be emptied, by the group they go with.
OWNED = {"predictions": ("predictions",), "streams": ("results", "stats_events", "dead_letters", "batch_stats")}


def purge(spark: SparkSession, root: str, groups: Sequence[str] = ("predictions", "streams")) -> DataFrame:
    """Empty the views of the given groups; returns each and the rows it still shows (0).

    Only what is committed now goes; days that no view shows are removed from the store.
    """
    unknown = set(groups) - set(OWNED)
    if unknown:
        raise ValueError(f"unknown groups: {sorted(unknown)}")
    table = scored_table(prepare_session(spark), root)
    names = [v for g in groups for v in OWNED[g]]
    last = table.commits().agg(F.max("committed_at")).first()[0]
    if last is not None:
        for name in names:
            table.set_mark(name, last + 1)
        table.sweep(scoring.VIEWS)
    left = [table.commits(n).agg(F.coalesce(F.sum("messages"), F.lit(0)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n in names]
    return functools.reduce(DataFrame.unionByName, left)
