"""Point-in-time history features for training (batch rules).

Every feature of a row depends on its user's strictly earlier transactions only
(equal timestamps exclude each other). The rows are first reduced to one per
(user, second); a transaction enters the 30-day window right after its own
second and leaves it 30 days later, so window counts are differences of running
totals and need no sliding frame. Running totals are bucketed by day, so a hot
user is spread over many tasks; the payload rows are shuffled once, on
(user, second).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnscore.functions import features as fx
from txnscore.operators.cumulate import cumulate
from txnscore.operators.latest import latest_by_key
from txnscore.plans.profiles import user_summary
from txnscore.schemas import CORRUPT

USER_SECOND = ["user_id", "timestamp"]


def _moment(**values: Column | None) -> Column:
    types = {"spend": "decimal(34,6)", "probe": "boolean"}
    names = ("at", "recent", "entered", "priced", "spend", "seen", "leaves", "probe")
    zero = F.lit(0)
    return F.struct(
        *[values.get(n, zero).cast(types.get(n, "bigint")).alias(n) for n in names]
    )


def prior_activity(txns: DataFrame) -> DataFrame:
    """Per (user, second), a summary of the user's strictly earlier transactions.

    ``prior`` and ``prior_spend`` cover all of them, ``recent`` and
    ``oldest_recent`` the last 30 days, ``previous`` and ``first_seen`` are times.
    """
    seconds = (
        txns.filter(F.col("user_id").isNotNull() & F.col("timestamp").isNotNull())
        .groupBy(*USER_SECOND)
        .agg(
            F.count(F.lit(1)).alias("txns"),
            F.count(fx.money(F.col("amount"))).alias("priced"),
            F.sum(fx.money(F.col("amount"))).alias("spend"),
        )
    )
    t, none = F.col("timestamp"), F.lit(None)
    last_recent = t + (fx.HISTORY_SECONDS - 1)
    arrival = _moment(
        at=t, recent=F.col("txns"), entered=F.col("txns"), priced=F.col("priced"),
        spend=F.col("spend"), seen=t, leaves=none, probe=F.lit(True),
    )
    departure = _moment(
        at=last_recent, recent=-F.col("txns"), seen=none, leaves=last_recent, probe=F.lit(False)
    )
    moments = (
        seconds.select("user_id", F.explode(F.array(arrival, departure)).alias("m"))
        .select("user_id", "m.*")
        .withColumn("day", F.floor(F.col("at") / fx.DAY_SECONDS))
    )
    totals = cumulate(
        moments,
        ["user_id"],
        "at",
        before={
            "recent": ("sum", "recent"),
            "prior": ("sum", "entered"),
            "prior_priced": ("sum", "priced"),
            "prior_spend": ("sum", "spend"),
            "previous": ("max", "seen"),
            "first_seen": ("min", "seen"),
        },
        # The oldest recent transaction is the next one to leave the window.
        onward={"next_leave": ("min", "leaves")},
        levels=["day"],
    )
    return totals.filter("probe").select(
        "user_id",
        F.col("at").alias("timestamp"),
        F.coalesce("prior", F.lit(0)).alias("prior"),
        F.coalesce("recent", F.lit(0)).alias("recent"),
        (F.col("prior_spend").cast("double") / F.nullif("prior_priced", F.lit(0))).alias("prior_avg"),
        "previous",
        "first_seen",
        F.when(F.col("recent") > 0, F.col("next_leave") - (fx.HISTORY_SECONDS - 1)).alias("oldest_recent"),
    )


def velocity(recent: Column, oldest: Column, now: Column) -> Column:
    """Recent transactions per day, over at least one day; 0 if there are none."""
    days = F.greatest(F.lit(1.0), (now - oldest) / float(fx.DAY_SECONDS))
    return F.when(recent > 0, recent / days).otherwise(0.0)


def history_features(activity: DataFrame) -> DataFrame:
    """The feature columns of ``prior_activity``; neutral where nothing is earlier."""
    now = F.col("timestamp")
    return activity.select(
        *USER_SECOND,
        (F.col("prior") == 0).alias("is_first"),
        velocity(F.col("recent"), F.col("oldest_recent"), now).alias("transaction_velocity"),
        F.coalesce("prior_avg", F.lit(0.0)).alias("avg_transaction_amount"),
        F.coalesce((now - F.col("first_seen")) / float(fx.DAY_SECONDS), F.lit(0.0)).alias(
            "days_since_first_seen"
        ),
        (now - F.col("previous")).alias("time_since_last_txn"),
    )


def with_history(txns: DataFrame) -> DataFrame:
    """``txns`` with the history features; one shuffle of the payload rows."""
    return _attach(txns, history_features(prior_activity(txns)))


def _attach(txns: DataFrame, per_second: DataFrame) -> DataFrame:
    joined = txns.join(per_second, USER_SECOND, "left")
    average = F.coalesce("avg_transaction_amount", F.lit(0.0))
    return joined.withColumns(
        {
            "is_first": F.coalesce("is_first", F.lit(True)),
            "transaction_velocity": F.coalesce("transaction_velocity", F.lit(0.0)),
            "avg_transaction_amount": average,
            "amount_vs_average_ratio": fx.ratio_to_average(F.col("amount"), average),
            "days_since_first_seen": F.coalesce("days_since_first_seen", F.lit(0.0)),
        }
    )


def offline_features(txns: DataFrame) -> DataFrame:
    """All batch features of every transaction (labels come from ``plans.labels``).

    Preferred card, home and segment come from the user's whole history, as in
    training they always did; rows without earlier ones keep the NEW values.
    They ride on the (user, second) rows, so the payload is joined only once.
    """
    users = user_summary(txns).select(
        "user_id",
        F.col("preferred_card"),
        F.col("home_location"),
        fx.spend_segment(F.col("total_spend")).alias("segment"),
    )
    per_second = history_features(prior_activity(txns)).join(users, "user_id", "left")
    rows = _attach(txns, per_second)
    known = ~F.col("is_first")
    flag = lambda hit: F.when(known & hit, 1).otherwise(0)
    return rows.withColumns(
        {
            **fx.time_features(F.col("timestamp")),
            "amount_category": fx.amount_category(F.col("amount"), null_nonpositive=True),
            "is_preferred_card": flag(F.col("card_provider") == F.col("preferred_card")),
            "is_home_location": flag(F.col("location") == F.col("home_location")),
            "user_segment": F.when(known, F.col("segment")).otherwise(fx.SEGMENT_NEW),
        }
    ).drop("is_first", "preferred_card", "home_location", "segment", "time_since_last_txn")


def recent_transactions(txns: DataFrame, limit: int = 10) -> DataFrame:
    """Each user's latest ``limit`` transactions, newest first as ``recency`` 1..limit.

    The rank filter lets Spark cut every map task's output to ``limit`` rows a
    user before the shuffle.
    """
    newest = Window.partitionBy("user_id").orderBy(
        F.coalesce("timestamp", F.lit(0)).desc(), F.col("transaction_id").desc()
    )
    ranked = txns.withColumn("recency", F.row_number().over(newest))
    return ranked.filter(F.col("recency") <= limit)


def _rejection(raw: DataFrame) -> Column:
    """Why a delivered row cannot be used, else NULL."""
    empty = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed") if CORRUPT in raw.columns else F
    return (
        reason.when(empty("transaction_id"), "no transaction id")
        .when(empty("user_id"), "no user")
        .when(fx.epoch_seconds(F.col("timestamp")).isNull(), "unreadable time")
        .when(fx.unusable(F.col("amount")), "unusable amount")
    )


def load_history(raw: DataFrame, seq: str | Sequence[str]) -> DataFrame:
    """Historical transactions ready for use: epoch timestamps, a location where
    the coordinates give one, and one row per transaction id (the last usable one).
    Rows that cannot be used are in ``rejected_history`` instead."""
    usable = raw.filter(_rejection(raw).isNull()).drop(CORRUPT)
    ready = usable.withColumns(
        {
            "timestamp": fx.epoch_seconds(F.col("timestamp")),
            "location": F.coalesce("location", fx.compose_location(F.col("lon"), F.col("lat"))),
        }
    )
    return latest_by_key(ready, "transaction_id", seq)


def rejected_history(raw: DataFrame) -> DataFrame:
    """The delivered rows ``load_history`` leaves out, as delivered, with a ``reason``:
    ``malformed``, ``no transaction id``, ``no user``, ``unreadable time``, ``unusable amount``."""
    return raw.withColumn("reason", _rejection(raw)).filter(F.col("reason").isNotNull())
