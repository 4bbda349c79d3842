"""Scored results: flagging, latest rows, latest predictions, retention, search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnscore.functions import features as fx
from txnscore.functions import report as rx
from txnscore.functions.messages import run_or_unknown
from txnscore.operators.latest import latest_by_key


def flag_predictions(scored: DataFrame, threshold: float) -> DataFrame:
    """``is_fraud`` by the serving threshold; an input label is kept as ``label``."""
    kept = scored.withColumnRenamed("is_fraud", "label") if "is_fraud" in scored.columns else scored
    return kept.withColumns(
        {
            "transaction_id": F.coalesce("transaction_id", F.lit("unknown")),
            "is_fraud": F.when(F.col("fraud_probability") >= threshold, 1).otherwise(0),
        }
    )


def latest_predictions(predictions: DataFrame, seq: str | Sequence[str]) -> DataFrame:
    """One prediction per transaction; a redelivered one replaces the earlier."""
    return latest_by_key(predictions, "transaction_id", seq)


def typed_results(messages: DataFrame) -> DataFrame:
    """Result messages with real types; the run comes from the payload, then from
    the message field, then is ``unknown``; unreadable latencies are 0."""
    payload_run = F.get_json_object("data", "$.run_id")
    return messages.withColumns(
        {
            "run_id": run_or_unknown(payload_run, F.col("run_id")),
            "latency_ms": rx.number_or_zero(F.col("latency_ms")),
            "is_fraud": F.col("is_fraud").try_cast("int"),
            "fraud_probability": rx.number_or_zero(F.col("fraud_probability")),
        }
    ).withColumn("status", rx.fraud_status(F.col("is_fraud")))


def latest_results(
    results: DataFrame, newest: str | Sequence[str], limit: int = 10, run_id: str | None = None
) -> DataFrame:
    """The newest results of one run or of all (a top-k report, filtered first)."""
    rows = results if run_id is None else results.filter(F.col("run_id") == run_id)
    order = [newest] if isinstance(newest, str) else list(newest)
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def retained(rows: DataFrame, at: str, now: Column, hours: int = 24) -> DataFrame:
    """The rows that are not older than ``hours`` at ``now``."""
    return rows.filter(F.col(at) >= now - F.make_dt_interval(hours=F.lit(hours)))


def user_history(txns: DataFrame, user_id: str) -> DataFrame:
    """All transactions of one user (the equality reaches the scan)."""
    return txns.filter(F.col("user_id") == user_id)


def search_transactions(
    txns: DataFrame,
    tags: Mapping[str, str | Sequence[str]] | None = None,
    ranges: Mapping[str, tuple[float | None, float | None]] | None = None,
    text: Mapping[str, str] | None = None,
    near: tuple[float, float, float] | None = None,
    order_by: Sequence[tuple[str, bool]] = (),
    limit: int | None = None,
) -> DataFrame:
    """Search by tag equality, inclusive numeric range, words in a text field and
    radius around a point (``near`` is lon, lat, km); all conditions must hold.

    ``order_by`` lists (column, descending).
    """
    rows = txns
    for name, wanted in (tags or {}).items():
        values = [wanted] if isinstance(wanted, str) else list(wanted)
        rows = rows.filter(F.col(name).isin(values))
    for name, (low, high) in (ranges or {}).items():
        if low is not None:
            rows = rows.filter(F.col(name) >= low)
        if high is not None:
            rows = rows.filter(F.col(name) <= high)
    for name, words in (text or {}).items():
        tokens = F.split(F.lower(name), "[^\\p{L}\\p{N}]+")
        for word in words.lower().split():
            rows = rows.filter(F.array_contains(tokens, word))
    if near is not None:
        lon, lat, km = near
        rows = rows.filter(fx.near_home(F.col("location"), F.lit(f"{lon},{lat}"), km))
    if order_by:
        rows = rows.orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c, down in order_by])
    return rows if limit is None else rows.limit(limit)


def search_profiles(
    profiles: DataFrame,
    tags: Mapping[str, str | Sequence[str]] | None = None,
    ranges: Mapping[str, tuple[float | None, float | None]] | None = None,
    near: tuple[float, float, float] | None = None,
    order_by: Sequence[tuple[str, bool]] = (),
    limit: int | None = None,
) -> DataFrame:
    """The same search over user profiles; the place searched is the home."""
    rows = profiles.withColumn("location", F.col("home_location"))
    return search_transactions(rows, tags, ranges, None, near, order_by, limit).drop("location")
