"""A micro-batch: what is scored, in how even tasks, and what it leaves behind."""

import json

import pytest
from pyspark.sql import functions as F

from txnscore.plans.results import flag_predictions
from txnscore.plans.serving import serving_features
from txnscore.session import scratch_dir
from txnscore.sources.files import Folder
from txnscore.sources.stored import ByUser
from txnscore.streaming import score as streaming

COMPACT = "user_id STRING, timestamp BIGINT, txns BIGINT, spend DECIMAL(34,6)"
PROFILES = (
    "user_id STRING, first_seen BIGINT, preferred_card STRING, user_segment STRING,"
    " home_location STRING, registration_date BIGINT"
)
START = 1_704_067_200


@pytest.fixture
def without_broadcast(spark):
    """Small tables would be broadcast and small partitions merged; this shows the shapes large ones get."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def stored(spark):
    history = spark.range(50).select(
        F.concat(F.lit("u"), "id").alias("user_id"), F.lit(START).alias("timestamp").cast("bigint"),
        F.lit(1).cast("bigint").alias("txns"), F.lit(2).cast("decimal(34,6)").alias("spend"),
    )
    return ByUser(history), ByUser(spark.createDataFrame([("u1", START, "VISA", "BASIC", "1,2", START)], PROFILES))


def message(i):
    row = {"transaction_id": f"t{i}", "merchant_id": "m", "amount": 1.0 + i, "timestamp": START + 5, "is_fraud": 1}
    return json.dumps(row if i % 3 == 0 else {**row, "user_id": f"u{i % 50}"})


def sizes(rows):
    return [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]


def decoded_copies(spark):
    return [n for n in Folder(spark, f"{scratch_dir(spark)}/txnscore").names() if n.startswith("decoded")]


def test_only_usable_messages_are_scored_and_evenly(spark, tmp_path, monkeypatch, without_broadcast):
    """Unusable messages have no user: they went through the model, all of them in one task."""
    usable, unusable = 24_000, 6_000
    lines = spark.createDataFrame([(message(i),) for i in range(usable)], "data STRING")
    messages = lines.unionByName(spark.range(unusable).select(F.lit("{broken").alias("data"))).repartition(4)
    seen = {}

    def scored(rows, model, threshold):
        seen["reasons"] = rows.filter("reason IS NOT NULL").count()
        seen["sizes"] = sizes(rows)
        return flag_predictions(rows.withColumn("fraud_probability", F.lit(0.9)), threshold)

    monkeypatch.setattr(streaming, "score", scored)
    job = streaming.ScoringJob(None, *stored(spark), str(tmp_path))
    job.process(messages, 0)
    assert seen["reasons"] == 0 and sum(seen["sizes"]) == usable
    assert max(seen["sizes"]) < 1.1 * usable / len(seen["sizes"]) and len(seen["sizes"]) == usable // 2_000

    rows = streaming.scored_table(spark, str(tmp_path)).rows()
    assert streaming.predictions(rows).agg(F.count("transaction_id"), F.sum("is_fraud"), F.sum("label")).first()[:] == (usable,) * 3
    dead = rows.filter("reason IS NOT NULL")
    assert streaming.dead_messages(rows).groupBy("data", "reason").count().first()[:] == ("{broken", "malformed", unusable)
    filled = [c for c in ("transaction_id", "is_fraud", "label", "amount", "fraud_probability", "run_id")]
    assert set(dead.select(*filled).distinct().first()) == {None}
    figures = streaming.scored_table(spark, str(tmp_path)).commits().first()
    assert (figures["messages"], figures["transactions"]) == (usable + unusable, usable)
    assert decoded_copies(spark) == []


def test_a_batch_without_usable_messages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "score", lambda rows, model, threshold: flag_predictions(rows.withColumn("fraud_probability", F.lit(0.9)), threshold))
    job = streaming.ScoringJob(None, *stored(spark), str(tmp_path))
    job.process(spark.createDataFrame([("{broken",), (None,)], "data STRING"), 0)
    rows = streaming.scored_table(spark, str(tmp_path)).rows()
    assert sorted(r["reason"] for r in streaming.dead_messages(rows).collect()) == ["malformed", "no payload"]
    assert streaming.predictions(rows).count() == 0


def test_a_failed_attempt_leaves_no_decoded_copy(spark, tmp_path, monkeypatch):
    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(streaming, "score", fails)
    job = streaming.ScoringJob(None, *stored(spark), str(tmp_path))
    with pytest.raises(RuntimeError):
        job.process(spark.createDataFrame([(message(1),)], "data STRING"), 0)
    assert decoded_copies(spark) == []


def test_rows_without_a_user_do_not_share_a_task(spark, without_broadcast):
    history, profiles = (t.plain for t in stored(spark))
    rows = spark.range(4_000).select(
        F.col("id").cast("string").alias("transaction_id"), F.when(F.col("id") % 10 == 0, "u1").alias("user_id"),
        F.lit("m").alias("merchant_id"), (F.col("id") + 0.5).alias("amount"), F.lit(START).cast("bigint").alias("timestamp"),
        F.lit("VISA").alias("card_provider"), F.lit("1,2").alias("location"),
    )
    found = serving_features(rows, history, profiles)
    assert sum(sizes(found)) == 4_000 and max(sizes(found)) < 2_000
    counts = {r["known"]: r["n"] for r in found.groupBy((F.col("transaction_velocity") > 0).alias("known")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {True: 400, False: 3_600}
