"""Batch and serving features against a per-row loop over the rules."""

import random
from collections import Counter

import pytest

from txnscore.plans.history import offline_features, recent_transactions, with_history
from txnscore.plans.profiles import user_profiles
from txnscore.plans.serving import compact_history, serving_features, user_metrics

DAY = 86400
SCHEMA = "transaction_id STRING, user_id STRING, merchant_id STRING, amount DOUBLE, timestamp BIGINT, card_provider STRING, location STRING"


def feed(seed, n, start=1_700_000_000, span=90 * DAY):
    """Random transactions; half belong to one user, many share a second or sit on a window edge."""
    rng = random.Random(seed)
    times = [start + rng.randrange(span) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        t = rng.choice(times) + rng.choice([0, 0, 30 * DAY, 30 * DAY - 1, 30 * DAY + 1, DAY])
        user = "hot" if rng.random() < 0.5 else f"u{rng.randrange(8)}"
        amount = rng.choice([None, 0.0, -3.0]) if rng.random() < 0.06 else rng.randrange(1, 200_000) / 100
        rows.append(
            (f"t{i}", user, f"m{i % 3}", amount, t, rng.choice(["VISA", "AMEX", None]),
             rng.choice(["1,2", "1,2.05", "3,4"]))
        )
    return rows


def mode(pairs):
    """Most frequent value; first seen, then smallest, on ties."""
    count = Counter(v for _, v in pairs)
    first = {}
    for t, v in pairs:
        first[v] = min(t, first.get(v, t))
    return min(count, key=lambda v: (-count[v], first[v], v)) if count else None


def expected_offline(rows):
    out = {}
    for ident, user, _, amount, t, card, place in rows:
        mine = [r for r in rows if r[1] == user]
        prior = [r for r in mine if r[4] < t]
        if not prior:
            out[ident] = (0.0, 0.0, 0.0, None, 0, 0, "NEW")
            continue
        recent = [r[4] for r in prior if r[4] > t - 30 * DAY]
        velocity = len(recent) / max(1, (t - min(recent)) / DAY) if recent else 0.0
        amounts = [r[3] for r in prior if r[3] is not None]
        spend = sum(r[3] or 0 for r in mine)
        segment = "PREMIUM" if spend > 5000 else "STANDARD" if spend > 1000 else "BASIC"
        out[ident] = (
            velocity,
            sum(amounts) / len(amounts) if amounts else 0.0,
            (t - min(r[4] for r in mine)) / DAY,
            t - max(r[4] for r in prior),
            int(card is not None and card == mode([(r[4], r[5]) for r in mine if r[5] is not None])),
            int(place == mode([(r[4], r[6]) for r in mine])),
            segment,
        )
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_offline_features_equal_the_loop(spark, seed):
    rows = feed(seed, 240)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["transaction_id"]: r for r in offline_features(df).collect()}
    gap = {r["transaction_id"]: r["time_since_last_txn"] for r in with_history(df).collect()}
    want = expected_offline(rows)
    assert set(got) == set(want)
    for ident, (velocity, average, days, since, card, home, segment) in want.items():
        r = got[ident]
        assert r["transaction_velocity"] == pytest.approx(velocity, rel=1e-12)
        assert r["avg_transaction_amount"] == pytest.approx(average, rel=1e-12)
        assert r["days_since_first_seen"] == pytest.approx(days, rel=1e-12)
        assert (gap[ident], r["is_preferred_card"], r["is_home_location"], r["user_segment"]) == (since, card, home, segment)
        if r["amount"] is not None:
            ratio = r["amount"] / average if average > 0 else 1.0
            assert r["amount_vs_average_ratio"] == pytest.approx(ratio, rel=1e-12)


def test_rows_without_user_or_time_are_kept_with_neutral_history(spark):
    rows = [("a", None, "m", 5.0, 10, "VISA", "1,2"), ("b", "u", "m", 5.0, None, "VISA", "1,2"), ("c", "u", "m", 7.0, 20, "VISA", "1,2")]
    got = {r["transaction_id"]: r for r in offline_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == ["a", "b", "c"]
    for r in got.values():
        assert (r["transaction_velocity"], r["avg_transaction_amount"], r["user_segment"]) == (0.0, 0.0, "NEW")


def expected_serving(txn, history, profiles):
    _, user, _, amount, t, card, place = txn
    profile = profiles.get(user, (0, "UNKNOWN", "NEW", "0,0"))
    when = t or 0
    amount = amount or 0.0
    if when:
        recent = [r[3] or 0.0 for r in history if r[1] == user and (r[4] or 0) >= when - 30 * DAY]
        velocity, average = len(recent) / 30, sum(recent) / max(1, len(recent))
        days = (when - profile[0]) / DAY
    else:
        velocity = average = days = 0.0
    near = False
    if place and place != "bad" and profile[3] != "0,0":
        (a, b), (c, d) = ([float(x) for x in p.split(",")] for p in (place, profile[3]))
        near = 111.2 * ((a - c) ** 2 + (b - d) ** 2) ** 0.5 <= 10
    return (
        velocity, average, amount / average if average > 0 else 1.0, days,
        int(card == profile[1]), int(near), profile[2],
        "low" if amount <= 100 else "medium" if amount <= 500 else "high" if amount <= 1000 else "very_high",
        card or "UNKNOWN",
    )


def test_serving_features_equal_the_loop(spark):
    history = feed(3, 200)
    live = feed(4, 120, start=1_700_000_000 + 40 * DAY)
    live += [("x1", "stranger", "m", 5.0, 1_705_000_000, "VISA", "1,2"), ("x2", "hot", "m", None, None, None, ""),
             ("x3", "hot", "m", 9.0, 0, "VISA", "bad"), ("x4", None, None, 9.0, 1_705_000_000, None, None)]
    stored = spark.createDataFrame(history, SCHEMA)
    table = user_profiles(stored)
    profiles = {
        r["user_id"]: (r["first_seen"], r["preferred_card"], r["user_segment"], r["home_location"])
        for r in table.collect()
    }
    asked = spark.createDataFrame(live, SCHEMA)
    got = {r["transaction_id"]: r for r in serving_features(asked, compact_history(stored), table).collect()}
    assert len(got) == len(live)
    for txn in live:
        r, want = got[txn[0]], expected_serving(txn, history, profiles)
        numbers = (r["transaction_velocity"], r["avg_transaction_amount"], r["amount_vs_average_ratio"], r["days_since_first_seen"])
        assert numbers == pytest.approx(want[:4], rel=1e-12), txn
        assert (r["is_preferred_card"], r["is_home_location"], r["user_segment"], r["amount_category"], r["card_provider"]) == want[4:], txn


def test_as_of_takes_strictly_earlier_rows_only(spark):
    rows = feed(5, 150)
    df = spark.createDataFrame(rows, SCHEMA)
    got = user_metrics(df, compact_history(df), user_profiles(df), as_of=True).collect()
    for r in got:
        t = r["timestamp"]
        want = sum(1 for x in rows if x[1] == r["user_id"] and t - 30 * DAY <= x[4] < t)
        assert r["transaction_count_30d"] == want


def test_recent_transactions(spark):
    rows = feed(6, 200)
    got = recent_transactions(spark.createDataFrame(rows, SCHEMA), 10).collect()
    for user in {r[1] for r in rows}:
        mine = sorted(((r[4], r[0]) for r in rows if r[1] == user), reverse=True)[:10]
        assert [(r["timestamp"], r["transaction_id"]) for r in sorted(got, key=lambda r: r["recency"]) if r["user_id"] == user] == mine


def test_profile_defaults_and_ties(spark):
    rows = [
        ("1", "u", "m", 10.0, 5, None, ""), ("2", "u", "m", 20.0, 6, None, None),
        ("3", "w", "m", 5001.0, 9, "VISA", "3,4"), ("4", "w", "m", None, None, "AMEX", "1,2"),
    ]
    got = {r["user_id"]: r.asDict() for r in user_profiles(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["u"] == {"user_id": "u", "first_seen": 5, "preferred_card": "UNKNOWN", "user_segment": "BASIC",
                        "home_location": "0,0", "registration_date": 5}
    # A transaction without a time says nothing about when the user was first seen.
    assert got["w"] == {"user_id": "w", "first_seen": 9, "preferred_card": "VISA", "user_segment": "PREMIUM",
                        "home_location": "3,4", "registration_date": 9}
