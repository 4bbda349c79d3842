"""User profiles from historical transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnscore.functions import features as fx
from txnscore.operators.modes import preference

PROFILE_DEFAULTS = {
    "first_seen": 0,
    "preferred_card": fx.UNKNOWN,
    "user_segment": fx.SEGMENT_NEW,
    "home_location": fx.NO_HOME,
    "registration_date": 0,
}


def user_summary(
    txns: DataFrame, card: Column | None = None, location: Column | None = None
) -> DataFrame:
    """Per user: first_seen, preferred_card, home_location, total_spend, txn_count.

    One scan: every transaction counts once towards its card and once towards
    its location; the counts are partially aggregated before the shuffle, so
    a user's row count does not matter.
    """
    card = F.col("card_provider") if card is None else card
    location = F.col("location") if location is None else location
    votes = F.array(
        F.struct(
            F.lit("card").alias("kind"),
            card.alias("value"),
            F.lit(1).alias("txns"),
            F.coalesce(fx.money(F.col("amount")), fx.money(F.lit(0.0))).alias("spend"),
        ),
        F.struct(
            F.lit("home").alias("kind"),
            location.alias("value"),
            F.lit(0).alias("txns"),
            fx.money(F.lit(0.0)).alias("spend"),
        ),
    )
    counted = (
        txns.filter(F.col("user_id").isNotNull())
        .select("user_id", F.col("timestamp").alias("seen"), F.explode(votes).alias("vote"))
        .groupBy("user_id", "vote.kind", "vote.value")
        .agg(
            F.count(F.lit(1)).alias("uses"),
            F.min("seen").alias("first_use"),
            F.sum("vote.spend").alias("spend"),
            F.sum("vote.txns").alias("txns"),
        )
    )
    kind = F.col("kind")
    return counted.groupBy("user_id").agg(
        F.min("first_use").alias("first_seen"),
        preference("value", "uses", "first_use", kind == "card").alias("preferred_card"),
        preference("value", "uses", "first_use", kind == "home").alias("home_location"),
        F.sum("spend").alias("total_spend"),
        F.sum("txns").alias("txn_count"),
    )


def user_profiles(txns: DataFrame) -> DataFrame:
    """One profile per user: a missing card counts as UNKNOWN, an empty location not at all.

    Transactions without a time say nothing about when a user was first seen.
    """
    place = F.col("location")
    summary = user_summary(
        txns,
        card=F.coalesce("card_provider", F.lit(fx.UNKNOWN)),
        location=F.when(place != "", place),
    )
    return summary.select(
        "user_id",
        F.coalesce("first_seen", F.lit(0)).alias("first_seen"),
        "preferred_card",
        fx.spend_segment(F.col("total_spend")).alias("user_segment"),
        F.coalesce("home_location", F.lit(fx.NO_HOME)).alias("home_location"),
        F.coalesce("first_seen", F.lit(0)).alias("registration_date"),
    )


def user_segments(txns: DataFrame) -> DataFrame:
    spent = txns.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.sum(fx.money(F.coalesce("amount", F.lit(0.0)))).alias("total_spend")
    )
    return spent.select(
        "user_id",
        F.col("total_spend").cast("double").alias("total_spend"),
        fx.spend_segment(F.col("total_spend")).alias("user_segment"),
    )


def user_count(txns: DataFrame) -> DataFrame:
    return txns.agg(F.countDistinct("user_id").alias("users"))


def with_profile(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Left join by user; users without a profile get the default one.

    No broadcast hint: the profile table grows with the users, so Spark picks
    the join by size, and AQE splits a hot user's partition of ``rows``.
    """
    joined = rows.join(profiles.select("user_id", *PROFILE_DEFAULTS), "user_id", "left")
    return joined.withColumns(
        {name: F.coalesce(name, F.lit(value)) for name, value in PROFILE_DEFAULTS.items()}
    )
