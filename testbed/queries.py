"""Every registered query: the library's plans over views of the supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testbed.views import spark_view
from txnscore.config import DEFAULTS
from txnscore.functions import features as fx
from txnscore.functions.messages import dead_letters, decode_messages, parse_messages
from txnscore import jobs
from txnscore.ml import model as ml
from txnscore.ml.forest import node_table, walk
from txnscore.ml.metrics import classification_report, confusion_matrix, eval_metrics, flagged, roc_auc
from txnscore.ml.registry import ModelRegistry
from txnscore.operators.latest import latest_by_key
from txnscore.operators.modes import most_frequent
from txnscore.plans import history as hist
from txnscore.plans import latency, results, runstats
from txnscore.plans import profiles as prof
from txnscore.plans import serving as srv
from txnscore.plans.labels import add_fraud_labels, fraud_scores, score_inputs, score_scale, stratified_split
from txnscore.schemas import CATEGORICAL_FEATURES, MODEL_FEATURES, NUMERIC_FEATURES, RAW_TRANSACTION, RESULT_MESSAGE, RUN_CHANGE
from txnscore.session import fresh_path, materialize, prepare, spread
from txnscore.sources import readers, sinks
from txnscore.sources.batches import BatchTable
from txnscore.sources.stored import read_by_user
from txnscore.sources.versions import VersionedLog
from txnscore.streaming.score import ScoringJob, scored_table
from txnscore.streaming.tail import drain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Views:
    """The derived views of one scale folder, and plans several queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return spark_view(self.spark, self.sf_dir, name)

    def stats_events(self) -> DataFrame:
        return self.results.withColumn("is_fraud", F.col("is_fraud") == 1)

    def workers(self) -> DataFrame:
        return runstats.worker_stats(self.stats_events())

    def runs(self) -> DataFrame:
        return runstats.runs_table(self.run_log)

    def profiles(self) -> DataFrame:
        return prof.user_profiles(self.txns)

    def compact(self) -> DataFrame:
        return srv.compact_history(self.txns)

    def past_profiles(self) -> DataFrame:
        """Of the serving split: what was known before the live part began."""
        return prof.user_profiles(self.history)

    def past_compact(self) -> DataFrame:
        return srv.compact_history(self.history)

    def daily_workers(self) -> DataFrame:
        """Worker snapshots of each day, as several sources of the same worker."""
        days = self.results.withColumns(
            {
                "day": F.date_format("timestamp", "yyyyMMdd"),
                "latency_ms": F.when(F.col("user_num") % 7 != 0, F.col("latency_ms")),
            }
        )
        keys = [*runstats.WORKER, "day"]
        counted = days.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("transactions"),
            F.sum("is_fraud").alias("fraud_count"),
            F.max("batch_size").alias("batch_size"),
            F.bool_or(F.col("batch_size") > 9).alias("parallel_mode"),
            F.max(F.col("batch_size") % 4).alias("threads"),
            F.min("timestamp").alias("start_time"),
            (F.count(F.lit(1)) * 2.0).alias("processing_time"),
        )
        stats = latency.latency_stats(days, keys, "latency_ms").withColumnRenamed("count", "latency_count")
        return counted.join(stats, keys, "left").withColumn(
            "latency_count", F.coalesce("latency_count", F.lit(0))
        )


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Views(prepare(spark), sf_dir.rstrip("/")))

    QUERIES[fn.__name__] = run
    return fn


# --- scans and sinks -------------------------------------------------------


@query
def scan_json_txns(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "json")
    v.deliveries.select(*RAW_TRANSACTION.fieldNames()).write.json(path)
    return readers.scan_json_transactions(v.spark, path, multiline=False)


@query
def load_history(v: Views) -> DataFrame:
    return hist.load_history(v.deliveries, "seq").drop("lat", "lon")


@query
def rejected_history(v: Views) -> DataFrame:
    return hist.rejected_history(v.rough_deliveries).select("seq", "transaction_id", "user_id", "reason")


@query
def load_rough_history(v: Views) -> DataFrame:
    return hist.load_history(v.rough_deliveries, "seq").drop("lat", "lon")


@query
def rough_history_averages(v: Views) -> DataFrame:
    """Unusable amounts are in neither the sum nor the count of an average."""
    rows = v.rough_deliveries.withColumn("timestamp", fx.epoch_seconds(F.col("timestamp")))
    rows = rows.filter("user_id IS NOT NULL AND timestamp IS NOT NULL")
    return hist.with_history(rows).select("seq", fx.half_up(F.col("avg_transaction_amount"), 6).alias("avg_transaction_amount"))


@query
def parquet_round_trip(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "table")
    sinks.save_table(v.txns, path)
    return readers.read_table(v.spark, path).select("transaction_id", "user_id", "amount", "timestamp")


@query
def latest_by_key_(v: Views) -> DataFrame:
    rows = v.deliveries.select("transaction_id", "seq", "user_id", "amount", "card_provider")
    return latest_by_key(rows, "transaction_id", "seq")


@query
def decode_messages_(v: Views) -> DataFrame:
    return decode_messages(v.messages).select(
        "event_id", "transaction_id", "user_id", "merchant_id", "amount", "timestamp",
        "card_provider", "location", "run_id", "is_fraud", "synthetic",
    )


@query
def dead_letters_(v: Views) -> DataFrame:
    return dead_letters(parse_messages(v.messages))


@query
def latest_predictions(v: Views) -> DataFrame:
    scored = v.deliveries.select(
        "transaction_id", "seq", "user_id", (F.col("seq") % 100 / 100.0).alias("fraud_probability")
    )
    return results.latest_predictions(results.flag_predictions(scored, DEFAULTS.fraud_threshold), "seq")


@query
def worker_stats(v: Views) -> DataFrame:
    return v.workers()


@query
def worker_stats_snapshot(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "workers")
    sinks.replace_partition(v.workers(), path, "run_id")
    return v.spark.read.option("recursiveFileLookup", "false").parquet(path).select(
        "run_id", "worker_id", "transactions", "fraud_count", "p95_ms"
    )


@query
def run_metadata(v: Views) -> DataFrame:
    return runstats.run_metadata(v.run_log)


@query
def run_metadata_merge(v: Views) -> DataFrame:
    return runstats.merge_run_changes(v.run_log)


@query
def run_stats_json(v: Views) -> DataFrame:
    """The documents, parsed back to the columns they were made of."""
    workers = v.workers()
    documents = runstats.run_stats_json(runstats.run_stats(v.runs(), workers), workers)
    part = lambda path, kind: F.get_json_object("document", f"$.{path}").cast(kind).alias(path.replace(".", "_"))
    counts, figures = ("transactions", "fraud_count", "worker_count", "latency.count"), ("fraud_ratio", "duration_seconds", "actual_tps")
    latency_names = [f"latency.{n}" for n in latency.LATENCY_FIELDS]
    listed = F.from_json(F.get_json_object("document", "$.workers"), "map<string, struct<transactions: bigint>>")
    held = F.aggregate(F.map_values(listed), F.lit(0).cast("bigint"), lambda n, w: n + w["transactions"])
    return documents.select(
        "run_id",
        *[part(n, "bigint") for n in counts],
        *[part(n, "double") for n in (*figures, *latency_names)],
        part("metadata.pattern", "string"),
        part("metadata.complete", "boolean"),
        F.array_join(F.from_json(F.get_json_object("document", "$.worker_ids"), "array<string>"), ",").alias("worker_ids"),
        F.coalesce(held, F.lit(0)).alias("worker_transactions"),
    )


@query
def purge(v: Views) -> DataFrame:
    """One view of the stored batches is emptied; the others, and what is not theirs, keep their rows."""
    root = fresh_path(v.spark, "owned")
    table = scored_table(v.spark, root)
    rows = v.scored.withColumns({"reason": F.lit(None).cast("string"), "data": F.lit(None).cast("string")})
    attempt = table.write(rows, "feed", 0, 1_700_000_000_000_000)
    table.commit("feed", 0, attempt, messages=rows.count(), transactions=rows.count(), avg_ms=1.0)
    sinks.save_table(v.run_log, f"{root}/kept")
    gone = jobs.purge(v.spark, root, ("predictions",))
    left = table.rows("results").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("results").alias("table"), "rows")
    kept = v.spark.read.parquet(f"{root}/kept").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("kept").alias("table"), "rows")
    return gone.unionByName(left).unionByName(kept)


@query
def run_log_expiry(v: Views) -> DataFrame:
    """Old runs leave a log that is rewritten while changes of others, and of theirs, arrive."""
    log = VersionedLog(v.spark, fresh_path(v.spark, "log"), RUN_CHANGE)
    changes = v.run_log.withColumn("fraud_percentage", F.lit(None).cast("double")).select(*RUN_CHANGE.names)
    part = lambda k: log.append(changes.filter(F.col("seq") % 3 == k))
    part(0)
    part(1)

    def recent(rows: DataFrame) -> DataFrame:
        part(2)
        last = rows.groupBy("run_id").agg(F.max("seq").alias("last"))
        kept = last.filter(F.col("last") >= rows.agg(F.max("seq")).scalar() - 100)
        return rows.join(kept.select("run_id"), "run_id", "left_semi")

    log.rewrite(recent)
    log.vacuum(versions=1)
    return log.rows().select("run_id", "seq", "pattern", "complete", "transactions")


@query
def retention(v: Views) -> DataFrame:
    rows = v.results
    newest = rows.agg(F.max("timestamp")).scalar()
    return results.retained(rows, "timestamp", newest, DEFAULTS.retention_hours).select(
        "transaction_id", "run_id", "worker_id"
    )


# --- scalar functions ------------------------------------------------------


@query
def parse_timestamp(v: Views) -> DataFrame:
    return v.time_texts.select("event_id", fx.epoch_seconds(F.col("raw")).alias("epoch"))


@query
def time_features(v: Views) -> DataFrame:
    return v.txns.select("transaction_id", "timestamp").withColumns(fx.time_features(F.col("timestamp")))


@query
def amount_category(v: Views) -> DataFrame:
    amount = F.col("amount")
    return v.amounts.select(
        "event_id",
        fx.amount_category(amount, null_nonpositive=True).alias("batch_category"),
        fx.amount_category(F.coalesce(amount, F.lit(0.0)), null_nonpositive=False).alias("serving_category"),
    )


def _at_home(v: Views) -> DataFrame:
    rows = v.txns.select("transaction_id", "user_id", "location")
    return prof.with_profile(rows, v.profiles())


@query
def near_home(v: Views) -> DataFrame:
    return _at_home(v).select(
        "transaction_id", fx.near_home(F.col("location"), F.col("home_location")).cast("int").alias("near_home")
    )


@query
def location_deviation(v: Views) -> DataFrame:
    return _at_home(v).select(
        "transaction_id",
        F.round(fx.distance_km(F.col("location"), F.col("home_location")), 6).alias("km_from_home"),
    )


# --- profiles --------------------------------------------------------------


@query
def user_profiles(v: Views) -> DataFrame:
    return prof.user_profiles(v.txns)


@query
def preferred_card(v: Views) -> DataFrame:
    cards = v.order_txns.filter(F.col("card_provider").isNotNull())
    return most_frequent(cards, "user_id", "card_provider", "timestamp")


@query
def home_location(v: Views) -> DataFrame:
    return most_frequent(v.txns, "user_id", "location", "timestamp")


@query
def user_segments(v: Views) -> DataFrame:
    return prof.user_segments(v.order_txns)


@query
def user_count(v: Views) -> DataFrame:
    return prof.user_count(v.order_txns)


@query
def profile_lookup(v: Views) -> DataFrame:
    return prof.with_profile(v.txns.select("transaction_id", "user_id"), v.profiles())


# --- batch features --------------------------------------------------------


@query
def offline_features(v: Views) -> DataFrame:
    return hist.offline_features(v.txns.drop("event_id", "user_num", "currency"))


@query
def offline_features_sparse(v: Views) -> DataFrame:
    return hist.offline_features(v.order_txns)


def _history(rows: DataFrame, *columns: str) -> DataFrame:
    return hist.with_history(rows).select("transaction_id", *columns)


@query
def txn_velocity_30d(v: Views) -> DataFrame:
    return _history(v.order_txns, "transaction_velocity")


@query
def prior_avg_amount(v: Views) -> DataFrame:
    return _history(v.order_txns, "avg_transaction_amount")


@query
def amount_ratio(v: Views) -> DataFrame:
    return _history(v.order_txns, "amount_vs_average_ratio")


@query
def days_since_first_seen(v: Views) -> DataFrame:
    return _history(v.order_txns, "days_since_first_seen")


@query
def time_since_last_txn(v: Views) -> DataFrame:
    return _history(v.order_txns, "time_since_last_txn")


@query
def recent_transactions(v: Views) -> DataFrame:
    return hist.recent_transactions(v.txns.select("transaction_id", "user_id", "timestamp", "amount"))


@query
def user_history(v: Views) -> DataFrame:
    return results.user_history(v.txns, "USER7").select("transaction_id", "user_id", "amount", "timestamp")


@query
def search_txns(v: Views) -> DataFrame:
    return results.search_transactions(
        v.deliveries,
        tags={"card_provider": ["VISA", "AMEX"], "currency": "USD"},
        ranges={"amount": (50.0, 900.0)},
        text={"vector_text": "User", "item_name": "item"},
        near=(-74.0059, 40.7128, 15.0),
    ).select("seq", "transaction_id", "user_id", "amount", "location")


@query
def fraud_score(v: Views) -> DataFrame:
    inputs = score_inputs(hist.offline_features(v.txns))
    return fraud_scores(inputs, scale=score_scale(inputs)).select("transaction_id", F.round("fraud_score", 6).alias("fraud_score"))


@query
def fraud_labels(v: Views) -> DataFrame:
    inputs = score_inputs(hist.offline_features(v.txns))
    return add_fraud_labels(inputs, inputs=inputs).select("transaction_id", "is_fraud")


@query
def stratified_split_(v: Views) -> DataFrame:
    return stratified_split(v.scored, "label", "transaction_id").select("transaction_id", "label", "is_test")


# --- serving features ------------------------------------------------------


@query
def serving_metrics(v: Views) -> DataFrame:
    return srv.user_metrics(v.live, v.past_compact(), v.past_profiles()).select(
        "user_id", "timestamp", "transaction_count_30d", "transaction_velocity",
        "avg_transaction_amount", "days_since_first_seen",
    )


@query
def serving_metrics_as_of(v: Views) -> DataFrame:
    """Backfill rule: every transaction against the earlier ones of the same feed."""
    return srv.user_metrics(v.txns, srv.compact_history(v.txns), v.profiles(), as_of=True).select(
        "user_id", "timestamp", "transaction_count_30d", "avg_transaction_amount"
    )


@query
def user_data(v: Views) -> DataFrame:
    stored = v.history.select("transaction_id", "user_id", "timestamp", "amount")
    found = srv.user_data(v.live, stored, v.past_compact(), v.past_profiles())
    return found.select(
        "user_id", "timestamp",
        F.col("profile.preferred_card").alias("preferred_card"),
        F.col("metrics.transaction_count_30d").alias("transaction_count_30d"),
        F.array_join("recent_transactions.transaction_id", ",").alias("recent_ids"),
    )


@query
def serving_features(v: Views) -> DataFrame:
    return srv.serving_features(v.live, v.past_compact(), v.past_profiles()).select("transaction_id", *MODEL_FEATURES)


# --- statistics mart -------------------------------------------------------


@query
def latency_stats(v: Views) -> DataFrame:
    return latency.latency_stats(v.results, runstats.WORKER, "latency_ms")


@query
def latency_small_sample(v: Views) -> DataFrame:
    rows = v.results.withColumn("day", F.date_format("timestamp", "yyyyMMdd"))
    return latency.latency_stats(rows, ["day", "user_num"], "latency_ms")


@query
def latency_merge(v: Views) -> DataFrame:
    return latency.merge_latency(v.workers(), ["run_id"], "latency_count")


@query
def worker_merge(v: Views) -> DataFrame:
    return runstats.merge_workers(v.daily_workers())


@query
def worker_union(v: Views) -> DataFrame:
    rows = v.results.groupBy(*runstats.WORKER).agg(F.count(F.lit(1)).alias("transactions"))
    mine = F.col("worker_id") == "worker-1"
    own = rows.filter(mine).withColumn("source", F.lit("own"))
    stored = rows.withColumns({"transactions": F.col("transactions") - 1, "source": F.lit("stored")})
    return runstats.own_first(own, stored)


@query
def run_stats(v: Views) -> DataFrame:
    return runstats.run_stats(v.runs(), v.workers())


@query
def run_stats_generator_only(v: Views) -> DataFrame:
    generated = v.workers().filter(F.col("worker_id") == runstats.GENERATOR)
    return runstats.run_stats(v.runs(), generated).select(
        "run_id", "transactions", "fraud_count", "worker_count", "latency_count", "p99_ms", "fraud_ratio"
    )


@query
def legacy_run_stats(v: Views) -> DataFrame:
    return runstats.legacy_run_stats(v.run_log, v.workers())


@query
def feed_stats(v: Views) -> DataFrame:
    feed = v.results.withColumn("timestamp", F.unix_seconds("timestamp"))
    return runstats.feed_stats(feed)


@query
def list_runs(v: Views) -> DataFrame:
    return runstats.list_runs(v.run_log)


@query
def run_ids(v: Views) -> DataFrame:
    return runstats.run_ids(v.run_keys, "key", "scores:runs:")


@query
def base_run_keys(v: Views) -> DataFrame:
    return runstats.base_run_keys(v.run_keys, "key")


@query
def latest_run_stats(v: Views) -> DataFrame:
    return runstats.latest_run_stats(v.run_log, v.workers())


@query
def run_report(v: Views) -> DataFrame:
    return runstats.run_report(runstats.run_stats(v.runs(), v.workers()))


@query
def worker_report(v: Views) -> DataFrame:
    return runstats.worker_report(runstats.merge_workers(v.daily_workers()))


@query
def latest_results(v: Views) -> DataFrame:
    typed = results.typed_results(v.result_messages)
    return results.latest_results(typed, "event_id", 10, "run-015").drop("data")


# --- evaluation and model --------------------------------------------------


@query
def flag_predictions(v: Views) -> DataFrame:
    rows = v.scored.withColumnRenamed("label", "is_fraud")
    return results.flag_predictions(rows, DEFAULTS.fraud_threshold)


def _flag() -> F.Column:
    return flagged(F.col("fraud_probability"), DEFAULTS.fraud_threshold)


@query
def eval_metrics_(v: Views) -> DataFrame:
    return eval_metrics(v.scored, "label", "fraud_probability", DEFAULTS.fraud_threshold)


@query
def confusion_matrix_(v: Views) -> DataFrame:
    return confusion_matrix(v.scored, "label", _flag())


@query
def classification_report_(v: Views) -> DataFrame:
    return classification_report(v.scored, "label", _flag())


@query
def roc_auc_(v: Views) -> DataFrame:
    return roc_auc(v.scored, "label", "fraud_probability")


def _feature_rows(v: Views) -> DataFrame:
    return srv.serving_features(v.txns, v.compact(), v.profiles())


@query
def scaler_fit(v: Views) -> DataFrame:
    fitted = ml.scaler_fit(_feature_rows(v))
    return fitted.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query
def scaled_features(v: Views) -> DataFrame:
    rows = _feature_rows(v)
    scaled = ml.scaled(rows, ml.scaler_fit(rows))
    return scaled.select("transaction_id", *[F.round(c, 6).alias(c) for c in NUMERIC_FEATURES])


@query
def encoder_fit(v: Views) -> DataFrame:
    return ml.encoder_fit(_feature_rows(v))


@query
def encoded_features(v: Views) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rows = materialize(_feature_rows(v), "features")
    categories, scaler = materialize(ml.category_table(rows), "categories"), ml.scaler_fit(rows)
    placed = ml.encoded_input(rows, categories, scaler)
    fitted = Pipeline(stages=ml.encoding_stages()).fit(placed)
    found = fitted.transform(placed).select("transaction_id", vector_to_array("features").alias("x"))
    widths = {r["feature"]: r["n"] for r in categories.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    # The category that each hot place of the vector stands for.
    found, at = found.withColumn("width", F.size("x")), len(NUMERIC_FEATURES) + 1
    for column in CATEGORICAL_FEATURES:
        own = categories.filter(F.col("feature") == column).select("place", F.col("category").alias(column))
        hot = F.array_position(F.slice("x", at, widths[column]), F.lit(1.0)) - 1
        found = found.withColumn("place", hot.cast("int")).join(own, "place", "left").drop("place")
        at += widths[column]
    return found.drop("x")


@lru_cache(maxsize=4)
def _trained(spark: SparkSession, sf_dir: str) -> ml.Trained:
    v = Views(spark, sf_dir)
    labelled = add_fraud_labels(materialize(hist.offline_features(v.txns), "features"))
    return ml.train(materialize(labelled, "training"))


@query
def train_eval(v: Views) -> DataFrame:
    """Rows of the test share by class, and whether the figures are what they can be."""
    cells, tail = ("tn", "fp", "fn", "tp"), "_at_threshold"
    figures = ("accuracy", f"accuracy{tail}", "roc_auc")
    return _trained(v.spark, v.sf_dir).metrics.select(
        "rows",
        (F.col("tn") + F.col("fp")).alias("negatives"),
        (F.col("fn") + F.col("tp")).alias("positives"),
        (sum(F.col(c + tail) for c in cells) == F.col("rows")).alias("all_counted"),
        F.forall(F.array(*figures), lambda x: x.between(0.0, 1.0)).alias("in_range"),
    )


def _checked(scored: DataFrame) -> DataFrame:
    """Predictions with what must hold of a probability and its flag, whatever the model."""
    p = F.col("fraud_probability")
    flag = (F.col("is_fraud") == 1) == (p >= DEFAULTS.fraud_threshold)
    return scored.withColumns({"in_range": p.between(0.0, 1.0), "flag_fits": flag})


@lru_cache(maxsize=4)
def serving_tables(spark: SparkSession, sf_dir: str) -> str:
    """The stored profiles and serving history of all transactions; returns their folder."""
    v, root = Views(spark, sf_dir), fresh_path(spark, "serving")
    jobs.save_serving(v.profiles(), v.compact(), root)
    return root


def _job(v: Views, out: str) -> ScoringJob:
    stored = serving_tables(v.spark, v.sf_dir)
    return ScoringJob(
        _trained(v.spark, v.sf_dir).model,
        read_by_user(v.spark, f"{stored}/serving_history"),
        read_by_user(v.spark, f"{stored}/profiles"),
        out,
    )


@query
def score_batch(v: Views) -> DataFrame:
    job = _job(v, fresh_path(v.spark, "score"))
    rows = v.txns.drop("event_id", "user_num")
    scored = job.predict(rows, size=rows.count())
    return _checked(scored).select("transaction_id", "user_id", "merchant_id", "amount", "timestamp", "card_provider", "location", "in_range", "flag_fits")


@query
def forest_walk(v: Views) -> DataFrame:
    """Every transaction's probability against a walk of the forest's node table, and its flag against both."""
    model = _trained(v.spark, v.sf_dir).model
    rows = materialize(_feature_rows(v).select("transaction_id", *MODEL_FEATURES), "features")
    rows = spread(rows, rows.count())
    found = ml.score(rows, model).join(walk(rows, node_table(v.spark, model), model), "transaction_id")
    close = F.abs(F.col("walked_probability") - F.col("fraud_probability")) < 1e-9
    flag = (F.col("is_fraud") == 1) == (F.col("walked_probability") >= DEFAULTS.fraud_threshold)
    near = F.abs(F.col("walked_probability") - DEFAULTS.fraud_threshold) < 1e-9
    return found.select("transaction_id", close.alias("walk_agrees"), (flag | near).alias("flag_agrees"))


@query
def model_versions(v: Views) -> DataFrame:
    """The registry's versions, each loaded again and asked to score every transaction."""
    registry = ModelRegistry(v.spark, fresh_path(v.spark, "registry"))
    trained = _trained(v.spark, v.sf_dir)
    registry.save(trained.model, "first")
    registry.save(trained.model, "second", trained.metrics)
    listed = registry.versions()
    rows = materialize(_feature_rows(v).select("transaction_id", *MODEL_FEATURES), "features")
    rows = spread(rows, rows.count())
    counted = [
        ml.score(rows, registry.load(r["version"])).agg(F.count("fraud_probability").alias("rows_scored")).withColumn("version", F.lit(r["version"]))
        for r in listed.select("version").collect()
    ]
    found = reduce(DataFrame.unionByName, counted)
    return listed.join(found, "version").select("name", "description", F.col("metrics").isNotNull().alias("has_metrics"), "rows_scored")


# --- streaming -------------------------------------------------------------


@lru_cache(maxsize=4)
def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """Score the whole message feed in several micro-batches; returns the output root."""
    v = Views(spark, sf_dir)
    out = fresh_path(spark, "stream")
    feed = f"{out}/feed"
    spark_view(spark, sf_dir, "messages", tasks=24).select("data").write.parquet(feed)
    job = _job(v, out)
    running = job.start(readers.stream_messages(spark, feed, files_per_trigger=8), available_now=True)
    running.awaitTermination()
    return out


@query
def stream_score(v: Views) -> DataFrame:
    latest = results.latest_predictions(jobs.predictions(v.spark, _streamed(v.spark, v.sf_dir)), ["processed_at", "batch_id", "arrival"])
    return _checked(latest).select("transaction_id", "user_id", "run_id", "amount", "timestamp", "in_range", "flag_fits")


@query
def stream_results(v: Views) -> DataFrame:
    """The results table: every usable message once, typed, with its processing metadata."""
    typed = results.typed_results(jobs.result_messages(v.spark, _streamed(v.spark, v.sf_dir)))
    inside = lambda field: F.get_json_object("data", f"$.{field}")
    return _checked(typed).select(
        "transaction_id", "user_id", "worker_id", "run_id", "in_range", "flag_fits",
        inside("merchant_id").alias("merchant_id"),
        (inside("batch_size").cast("int") > 0).alias("batched"),
        (F.col("latency_ms") > 0).alias("measured"),
        inside("processed_at").isNotNull().alias("stamped"),
    )


@query
def stream_transactions(v: Views) -> DataFrame:
    """What the stream delivered, apart from the model's part: every usable message once."""
    return jobs.predictions(v.spark, _streamed(v.spark, v.sf_dir)).select(
        "transaction_id", "user_id", "merchant_id", "amount", "timestamp", "card_provider", "location",
        "run_id", "label",
    )


@query
def stream_dead_letters(v: Views) -> DataFrame:
    return jobs.dead_letters(v.spark, _streamed(v.spark, v.sf_dir)).select("data", "reason")


@query
def batch_stats(v: Views) -> DataFrame:
    """All micro-batches together, and whether their times fit their sizes."""
    rows = jobs.batch_stats(v.spark, _streamed(v.spark, v.sf_dir))
    mean = F.col("batch_ms") / F.greatest(F.col("transactions"), F.lit(1))
    return rows.agg(
        F.sum("transactions").alias("transactions"),
        F.bool_and(F.col("fraud_count").between(0, F.col("transactions"))).alias("fraud_fits"),
        F.bool_and((F.col("batch_ms") > 0) & (F.abs(F.col("avg_ms") - mean) < 1e-9 * F.col("batch_ms"))).alias("times_fit"),
    )


@query
def live_worker_stats(v: Views) -> DataFrame:
    """Statistics of the running workers; the measured times only have to fit each other."""
    found = runstats.worker_stats(jobs.stats_events(v.spark, _streamed(v.spark, v.sf_dir)))
    order = ("min_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms")
    sorted_ = F.forall(F.array(*[F.col(b) >= F.col(a) for a, b in zip(order, order[1:])]), lambda x: x)
    return found.select(
        "run_id", "worker_id", "transactions", "latency_count",
        sorted_.alias("ordered"), (F.col("fraud_count") <= F.col("transactions")).alias("fraud_fits"),
    )


@query
def stream_progress(v: Views) -> DataFrame:
    """Progress of the scoring query, batch by batch; the last totals must be those of the feed."""
    rows = jobs.stream_progress(v.spark, _streamed(v.spark, v.sf_dir))
    return rows.agg(
        F.max("messages_so_far").alias("messages"),
        F.max("transactions_so_far").alias("transactions"),
        F.max("dead_so_far").alias("dead"),
        (F.sum("messages") == F.max("messages_so_far")).alias("adds_up"),
        (F.count(F.lit(1)) == F.max("batch_id") - F.min("batch_id") + 1).alias("no_gap"),
        F.bool_and(F.col("messages_per_sec") > 0).alias("timed"),
    )


def _result_batches(v: Views) -> tuple[BatchTable, str]:
    """The result messages in four committed batches, and an attempt that failed after writing."""
    root = fresh_path(v.spark, "tail")
    table = BatchTable(v.spark, f"{root}/results")
    numbered = v.result_messages.withColumn("part", F.pmod(F.xxhash64("transaction_id"), F.lit(4)))
    for k in range(4):
        mine, at = numbered.filter(F.col("part") == k).drop("part", "event_id"), 1_700_000_000_000_000 + k
        table.write(mine, "feed", k, at)
        table.commit("feed", k, table.write(mine, "feed", k, at + 100))
    return table, root


def _tail_view(rows: DataFrame) -> DataFrame:
    return results.typed_results(rows.select(*RESULT_MESSAGE.fieldNames()))


@query
def tail_results_(v: Views) -> DataFrame:
    table, root = _result_batches(v)
    return drain(table, _tail_view, f"{root}/seen", f"{root}/position", "run-020", files_per_trigger=2).drop("data")


@query
def tail_latency(v: Views) -> DataFrame:
    """Latency per run of everything the tail has read so far."""
    table, root = _result_batches(v)
    seen = drain(table, _tail_view, f"{root}/seen", f"{root}/position")
    return latency.latency_stats(seen, ["run_id"], "latency_ms")


for _name in [n for n in QUERIES if n.endswith("_")]:
    QUERIES[_name.rstrip("_")] = QUERIES.pop(_name)
