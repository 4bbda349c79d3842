"""Serving features: live transactions against stored history and profiles.

The stored history is static here: live transactions never enter it, so a
batch and any split of it into micro-batches get the same features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnscore.functions import features as fx
from txnscore.operators.cumulate import cumulate
from txnscore.plans.history import recent_transactions
from txnscore.plans.profiles import PROFILE_DEFAULTS, with_profile

ASK = ["user_id", "timestamp"]


def compact_history(history: DataFrame) -> DataFrame:
    """Stored history reduced to one row per (user, second): the serving table."""
    return (
        history.filter(F.col("user_id").isNotNull())
        .groupBy("user_id", F.coalesce("timestamp", F.lit(0)).alias("timestamp"))
        .agg(
            F.count(F.lit(1)).alias("txns"),
            F.sum(F.coalesce(fx.money(F.col("amount")), fx.money(F.lit(0.0)))).alias("spend"),
        )
    )


def serving_activity(asks: DataFrame, compact: DataFrame, as_of: bool = False) -> DataFrame:
    """Count and spend of each asking user's stored transactions since 30 days before.

    ``asks`` holds distinct (user, second) pairs. A stored transaction counts
    until 30 days after its second; there is no upper bound on its time unless
    ``as_of`` asks for strictly earlier ones (for backfills). Running totals by
    user and day replace the range join, so no pairs are formed.
    """
    t = F.col("timestamp")
    # Only the asking users' stored seconds are unfolded, each user's from 30 days before the
    # earliest question on.
    users = asks.groupBy("user_id").agg(F.min(F.when(t != 0, t)).alias("oldest"))
    near = compact.join(users, "user_id").filter(t >= F.col("oldest") - fx.HISTORY_SECONDS)
    if as_of:
        near = compact.join(users, "user_id", "left_semi")
    stored = near.select(
        "user_id",
        F.explode(
            F.array(
                *([F.struct(t.alias("at"), F.lit(1).alias("sign"))] if as_of else []),
                F.struct((t + fx.HISTORY_SECONDS).alias("at"), F.lit(-1 if as_of else 1).alias("sign")),
            )
        ).alias("m"),
        "txns",
        "spend",
    ).select(
        "user_id",
        "m.at",
        (F.col("txns") * F.col("m.sign")).alias("txns"),
        (F.col("spend") * F.col("m.sign")).cast("decimal(34,6)").alias("spend"),
        F.lit(False).alias("probe"),
    )
    questions = asks.select(
        "user_id",
        t.alias("at"),
        F.lit(0).cast("bigint").alias("txns"),
        F.lit(0).cast("decimal(34,6)").alias("spend"),
        F.lit(True).alias("probe"),
    )
    moments = stored.unionByName(questions).withColumn("day", F.floor(F.col("at") / fx.DAY_SECONDS))
    measures = {"count_30d": ("sum", "txns"), "spend_30d": ("sum", "spend")}
    totals = cumulate(
        moments,
        ["user_id"],
        "at",
        before=measures if as_of else {},
        onward={} if as_of else measures,
        levels=["day"],
    )
    return totals.filter("probe").select(
        "user_id",
        F.col("at").alias("timestamp"),
        F.coalesce("count_30d", F.lit(0)).alias("count_30d"),
        F.coalesce(F.col("spend_30d").cast("double"), F.lit(0.0)).alias("spend_30d"),
    )


def user_metrics(
    txns: DataFrame, compact: DataFrame, profiles: DataFrame, as_of: bool = False
) -> DataFrame:
    """Profile and history metrics per distinct (user, second) of ``txns``.

    A missing or zero timestamp has no metrics: zeros, as for the model.
    """
    asks = (
        txns.filter(F.col("user_id").isNotNull())
        .select("user_id", F.coalesce("timestamp", F.lit(0)).alias("timestamp"))
        .distinct()
    )
    activity = serving_activity(asks, compact, as_of)
    now = F.col("timestamp")
    timed = now != 0
    rows = with_profile(activity, profiles)
    return rows.select(
        *ASK,
        *[n for n in PROFILE_DEFAULTS],
        F.when(timed, F.col("count_30d")).otherwise(0).alias("transaction_count_30d"),
        F.when(timed, F.col("count_30d") / 30.0).otherwise(0.0).alias("transaction_velocity"),
        F.when(timed, F.col("spend_30d") / F.greatest(F.lit(1), F.col("count_30d")))
        .otherwise(0.0)
        .alias("avg_transaction_amount"),
        F.when(timed, (now - F.col("first_seen")) / float(fx.DAY_SECONDS))
        .otherwise(0.0)
        .alias("days_since_first_seen"),
    )


def serving_features(
    txns: DataFrame,
    compact: DataFrame,
    profiles: DataFrame,
    radius_km: float = 10.0,
    as_of: bool = False,
) -> DataFrame:
    """``txns`` with the fourteen model features; defaults for unknown users."""
    metrics = user_metrics(txns, compact, profiles, as_of).withColumnRenamed("timestamp", "asked_at")
    # Rows without a user meet nothing; a hash of their own in the place of the time keeps
    # them from going to one task together.
    own = F.xxhash64(*[txns[c] for c in ("timestamp", "amount", "merchant_id", "location")])
    asked_at = F.when(txns["user_id"].isNull(), own).otherwise(F.coalesce(txns["timestamp"], F.lit(0)))
    joined = txns.join(
        metrics,
        (txns["user_id"] == metrics["user_id"]) & (asked_at == metrics["asked_at"]),
        "left",
    ).drop(metrics["user_id"])
    amount = F.coalesce("amount", F.lit(0.0))
    when = F.coalesce("timestamp", F.lit(0))
    average = F.coalesce("avg_transaction_amount", F.lit(0.0))
    filled = {n: F.coalesce(n, F.lit(v)) for n, v in PROFILE_DEFAULTS.items()}
    card = F.col("card_provider")
    # A transaction without a user still has an age: the default profile's.
    age = F.coalesce("days_since_first_seen", when / float(fx.DAY_SECONDS))
    return joined.withColumns(
        {
            "is_preferred_card": fx.same_value(card, filled["preferred_card"]),
            "is_home_location": fx.near_home(
                F.col("location"), filled["home_location"], radius_km
            ).cast("int"),
            "user_segment": filled["user_segment"],
            "amount_vs_average_ratio": fx.ratio_to_average(amount, average),
            "amount_category": fx.amount_category(amount, null_nonpositive=False),
            "transaction_velocity": F.coalesce("transaction_velocity", F.lit(0.0)),
            "avg_transaction_amount": average,
            "days_since_first_seen": age,
            "amount": amount,
            "card_provider": F.coalesce(card, F.lit(fx.UNKNOWN)),
            "merchant_id": F.coalesce("merchant_id", F.lit(fx.UNKNOWN)),
            **fx.time_features(when),
        }
    ).drop(
        "asked_at", "first_seen", "preferred_card", "home_location", "registration_date",
        "transaction_count_30d",
    )


def user_data(
    asks: DataFrame, history: DataFrame, compact: DataFrame, profiles: DataFrame, latest: int = 10
) -> DataFrame:
    """Per distinct (user, second): ``profile``, ``recent_transactions`` and ``metrics``.

    The list holds at most ``latest`` transactions of the stored history,
    newest first, so its size is bounded.
    """
    fields = [c for c in history.columns if c != "user_id"]
    listed = (
        recent_transactions(history.join(asks.select("user_id").distinct(), "user_id", "left_semi"), latest)
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("recency", F.struct(*fields).alias("txn")))).alias("ranked"))
        .select("user_id", F.col("ranked.txn").alias("recent_transactions"))
    )
    metrics = (
        "transaction_velocity", "avg_transaction_amount", "transaction_count_30d", "days_since_first_seen",
    )
    own_metrics = F.struct(*metrics)
    return user_metrics(asks, compact, profiles).join(listed, "user_id", "left").select(
        *ASK,
        F.struct("user_id", *PROFILE_DEFAULTS).alias("profile"),
        F.coalesce("recent_transactions", F.array()).alias("recent_transactions"),
        F.when(F.col("timestamp") != 0, own_metrics).alias("metrics"),
    )
