"""Latency summaries, run statistics, labels, split and evaluation metrics."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnscore.ml.metrics import argmax_class, classification_report, confusion_matrix, roc_auc
from txnscore.plans import runstats
from txnscore.plans.labels import add_fraud_labels, fraud_scores, stratified_split
from txnscore.plans.latency import latency_stats, merge_latency, percentiles


def expected_latency(values):
    v = sorted(values)
    n = len(v)
    if n >= 10:
        marks = [float(np.percentile(v, q)) for q in (50, 95, 99)]
    else:
        marks = [v[int(n * q)] for q in (0.5, 0.95, 0.99)]
    return [sum(v) / n, *marks, v[0], v[-1]]


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 300])
def test_latency_stats(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.random() * 500, rng.randrange(100) / 4, 7.0, 0.0]) for _ in range(n)]
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "k STRING, v DOUBLE")
    r = latency_stats(df, ["k"], "v", digits=6).first()
    got = [r["avg_ms"], r["p50_ms"], r["p95_ms"], r["p99_ms"], r["min_ms"], r["max_ms"]]
    assert got == pytest.approx(expected_latency(values), abs=1e-6)
    assert r["count"] == n


def test_latency_of_no_rows(spark):
    assert latency_stats(spark.createDataFrame([("g", None)], "k STRING, v DOUBLE"), ["k"], "v").count() == 0


def test_weighted_percentiles_equal_repeated_rows(spark):
    rows = [("r", 10.0, 4), ("r", 20.0, 5), ("r", 90.0, 2), ("s", 1.0, 100)]
    r = {x["k"]: x for x in percentiles(spark.createDataFrame(rows, "k STRING, v DOUBLE, w INT"), ["k"], "v", "w").collect()}
    spread = [10.0] * 4 + [20.0] * 5 + [90.0] * 2
    got = [r["r"]["p50_ms"], r["r"]["p95_ms"], r["r"]["p99_ms"]]
    assert got == pytest.approx([float(np.percentile(spread, q)) for q in (50, 95, 99)])


def test_merge_ignores_empty_sides_and_keeps_a_zero_minimum(spark):
    rows = [("r", 10.0, 9.0, 19.0, 20.0, 0.0, 30.0, 3), ("r", 20.0, 21.0, 22.0, 23.0, 5.0, 24.0, 1),
            ("r", 99.0, 99.0, 99.0, 99.0, 99.0, 99.0, 0)]
    df = spark.createDataFrame(rows, "k STRING, avg_ms DOUBLE, p50_ms DOUBLE, p95_ms DOUBLE, p99_ms DOUBLE, min_ms DOUBLE, max_ms DOUBLE, count INT")
    r = merge_latency(df, ["k"]).first()
    assert (r["avg_ms"], r["p50_ms"], r["p95_ms"], r["p99_ms"], r["min_ms"], r["max_ms"], r["count"]) == (
        12.5, 21.0, 22.0, 23.0, 0.0, 30.0, 4)


EVENTS = [
    ("r1", "w1", "a", 10.0, True, 4, 0), ("r1", "w1", "b", 20.0, False, 4, 2), ("r1", "w2", "c", 30.0, False, None, 0),
    ("r1", "generator", "d", 999.0, True, None, 0), ("r2", "generator", "e", 999.0, True, None, 5),
    ("lost", "w1", "f", 1.0, False, None, 5),
]


def statistics(spark):
    events = spark.createDataFrame(
        EVENTS, "run_id STRING, worker_id STRING, transaction_id STRING, latency_ms DOUBLE, is_fraud BOOLEAN, batch_size INT, s INT"
    ).withColumn("timestamp", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    changes = spark.sql(
        """SELECT * FROM VALUES ('r1', 1L, TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-01 00:00:08', 'wave', 5D, 0.2D, 2, true, 50L, 5L),
        ('r2', 1L, TIMESTAMP '2024-01-02 00:00:00', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
        ('r3', 1L, TIMESTAMP '2024-01-03 00:00:00', NULL, NULL, NULL, NULL, NULL, NULL, 7L, 2L),
        ('r4', 1L, TIMESTAMP '2024-01-04 00:00:00', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)
        AS t(run_id, seq, start_time, end_time, pattern, target_tps, fraud_ratio, thread_count, complete, transactions, fraud_count)"""
    )
    workers = runstats.worker_stats(events)
    return changes, workers


def test_run_stats(spark):
    changes, workers = statistics(spark)
    runs = runstats.runs_table(changes)
    got = {r["run_id"]: r for r in runstats.run_stats(runs, workers).collect()}
    assert sorted(got) == ["r1", "r2", "r3", "r4"]
    r = got["r1"]
    assert (r["transactions"], r["fraud_count"], r["latency_count"], r["worker_count"], r["worker_ids"]) == (3, 1, 3, 2, "w1,w2")
    assert (r["avg_ms"], r["p50_ms"], r["min_ms"], r["max_ms"]) == (20.0, 30.0, 10.0, 30.0)
    assert (r["duration_seconds"], r["actual_tps"], r["fraud_ratio"]) == (8.0, 0.38, 0.3333)
    assert (got["r2"]["transactions"], got["r2"]["fraud_count"], got["r2"]["latency_count"]) == (1, 1, 0)
    assert (got["r3"]["transactions"], got["r3"]["fraud_count"], got["r3"]["pattern"]) == (7, 2, "constant")
    assert (got["r4"]["transactions"], got["r4"]["actual_tps"], got["r4"]["worker_ids"]) == (0, 0.0, "")


def test_latest_run_and_unknown_run(spark):
    changes, workers = statistics(spark)
    assert runstats.latest_run_stats(changes, workers).first()["run_id"] == "r4"
    listed = runstats.list_runs(changes, 3).collect()
    assert [(r["run_id"], r["pattern"]) for r in listed] == [("r4", "unknown"), ("r3", "unknown"), ("r2", "unknown")]
    none = runstats.runs_table(changes).filter("run_id = 'nope'")
    assert runstats.run_stats(none, workers).count() == 0


def test_run_json(spark):
    changes, workers = statistics(spark)
    stats = runstats.run_stats(runstats.runs_table(changes), workers)
    rows = runstats.run_stats_json(stats, workers).collect()
    docs = {r["run_id"]: json.loads(r["document"]) for r in rows}
    r1 = docs["r1"]
    assert r1["metadata"]["end_time"] == "2024-01-01T00:00:08" and r1["metadata"]["pattern"] == "wave"
    assert sorted(r1["workers"]) == ["w1", "w2"] == r1["worker_ids"]
    assert r1["workers"]["w1"]["latency"]["avg_ms"] == 15.0
    assert docs["r4"]["workers"] in (None, {}) and docs["r4"]["worker_ids"] == []


def test_own_rows_win(spark):
    own = spark.createDataFrame([("r", "a", 1)], "run_id STRING, worker_id STRING, transactions INT")
    stored = spark.createDataFrame([("r", "a", 9), ("r", "b", 2), ("q", "a", 3)], own.schema)
    got = sorted(tuple(x) for x in runstats.own_first(own, stored).collect())
    assert got == [("q", "a", 3), ("r", "a", 1), ("r", "b", 2)]


@pytest.mark.parametrize("ratio", [0.0, 0.15, 0.5, 1.0])
def test_labels_take_exactly_the_top_share(spark, ratio):
    rng = random.Random(3)
    rows = [(f"t{i}", rng.randrange(1, 1000) / 10, rng.random() * 7, rng.randrange(2), rng.randrange(2)) for i in range(333)]
    df = spark.createDataFrame(
        rows, "transaction_id STRING, amount DOUBLE, amount_vs_average_ratio DOUBLE, is_preferred_card INT, is_home_location INT"
    )
    labelled = add_fraud_labels(df, ratio).collect()
    marked = [r["fraud_score"] for r in labelled if r["is_fraud"] == 1]
    rest = [r["fraud_score"] for r in labelled if r["is_fraud"] == 0]
    assert len(marked) == int(333 * ratio)
    if marked and rest:
        assert min(marked) >= max(rest)


def test_labels_with_equal_scores(spark, monkeypatch):
    from txnscore.plans import labels

    monkeypatch.setattr(labels.fx, "seeded_normal", lambda ident, seed, sigma: F.lit(0.0))
    df = spark.range(20).select(F.col("id").cast("string").alias("transaction_id"), F.lit(5.0).alias("amount"))
    assert {r["fraud_score"] for r in fraud_scores(df).collect()} == {0.0}
    first = sorted(r["transaction_id"] for r in add_fraud_labels(df, 0.15).collect() if r["is_fraud"] == 1)
    again = sorted(r["transaction_id"] for r in add_fraud_labels(df.repartition(5), 0.15).collect() if r["is_fraud"] == 1)
    assert len(first) == 3 and first == again


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(103).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    rows = stratified_split(df, "y", "id", 0.2).collect()
    assert sum(r["is_test"] for r in rows) == math.ceil(103 * 0.2)
    assert sum(r["is_test"] for r in rows if r["y"] == 1) == 3
    other = stratified_split(df.repartition(7), "y", "id", 0.2).collect()
    assert sorted(r["id"] for r in rows if r["is_test"]) == sorted(r["id"] for r in other if r["is_test"])
    shifted = stratified_split(df, "y", "id", 0.2, seed=7).collect()
    assert sorted(r["id"] for r in rows if r["is_test"]) != sorted(r["id"] for r in shifted if r["is_test"])


def test_split_refuses_a_label_with_many_values(spark):
    df = spark.range(1500).select("id", F.col("id").alias("y"))
    with pytest.raises(Exception, match="not a class label"):
        stratified_split(df, "y", "id").collect()


def test_auc_by_counting_pairs(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(2), round(rng.random() ** 3, rng.choice([1, 2, 6]))) for _ in range(200)]
    df = spark.createDataFrame(rows, "y INT, p DOUBLE")
    pos, neg = ([p for y, p in rows if y == c] for c in (1, 0))
    won = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert roc_auc(df, "y", "p").first()[0] == pytest.approx(won / (len(pos) * len(neg)), rel=1e-12)
    assert roc_auc(df.filter("y = 0"), "y", "p").first()[0] is None


def test_confusion_and_report_with_one_class(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.5), (0, 0.9)], "y INT, p DOUBLE")
    cells = {r["label"]: (r["predicted_0"], r["predicted_1"]) for r in confusion_matrix(df, "y", argmax_class(F.col("p"))).collect()}
    assert cells == {0: (2, 1), 1: (0, 0)}
    report = {r["class"]: r for r in classification_report(df, "y", argmax_class(F.col("p"))).collect()}
    assert report["1"]["recall"] == 0.0 and report["1"]["support"] == 0
    assert report["accuracy"]["f1_score"] == pytest.approx(2 / 3)
