"""The building blocks against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from txnscore.operators.cumulate import cumulate
from txnscore.operators.latest import latest_by_key, merge_fields
from txnscore.operators.modes import most_frequent
from txnscore.operators.ranks import values_at_ranks


def random_rows(seed, n=300):
    rng = random.Random(seed)
    # Half of all rows belong to one key; times repeat and may be negative.
    return [
        (i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}", rng.randrange(-50, 250), rng.randrange(-5, 6))
        for i in range(n)
    ]


@pytest.mark.parametrize("levels", [[], ["tens"], ["tens", "hundreds"]])
def test_cumulate_equals_brute_force(spark, levels):
    rows = random_rows(len(levels))
    df = spark.createDataFrame(rows, "i INT, k STRING, t BIGINT, x BIGINT").withColumns(
        {"tens": F.floor(F.col("t") / 10), "hundreds": F.floor(F.col("t") / 100)}
    )
    got = cumulate(
        df, ["k"], "t",
        before={"s": ("sum", "x"), "lo": ("min", "x"), "last": ("max", "t")},
        onward={"s_on": ("sum", "x"), "next": ("min", "t")},
        levels=levels,
    )
    seen = {r["i"]: (r["s"], r["lo"], r["last"], r["s_on"], r["next"]) for r in got.collect()}
    for i, k, t, _ in rows:
        prior = [(u, x) for _, j, u, x in rows if j == k and u < t]
        after = [(u, x) for _, j, u, x in rows if j == k and u >= t]
        none = (None, None, None)
        want = (sum(x for _, x in prior), min(x for _, x in prior), max(u for u, _ in prior)) if prior else none
        assert seen[i] == (*want, sum(x for _, x in after), min(u for u, _ in after))


def test_cumulate_without_keys_over_doubles(spark):
    df = spark.range(500).select((F.col("id") * 0.37 % 1).alias("v"), F.lit(1).alias("one")).groupBy("v").agg(
        F.sum("one").alias("c")
    ).withColumn("b", F.floor(F.col("v") * 16))
    got = cumulate(df, [], "v", {"below": ("sum", "c")}, levels=["b"], distinct_order=True).collect()
    values = sorted((r["v"], r["c"]) for r in got)
    total = 0
    want = {}
    for v, c in values:
        want[v], total = (total or None), total + c
    assert {r["v"]: r["below"] for r in got} == want


@pytest.mark.parametrize("few", [True, False])
def test_values_at_ranks(spark, few):
    rows = random_rows(9, 400)
    df = spark.createDataFrame(rows, "i INT, k STRING, t BIGINT, x BIGINT").withColumn("bin", F.floor(F.col("t") / 40))
    ranks = lambda n: [F.lit(0), F.floor(n / 2), n - 1, n]
    got = values_at_ranks(df, ["k"], ["bin"], "t", ranks, few_keys=few).collect()
    for key in {r[1] for r in rows}:
        times = sorted(r[2] for r in rows if r[1] == key)
        slots = {r["slot"]: r["value"] for r in got if r["k"] == key}
        assert slots == {0: times[0], 1: times[len(times) // 2], 2: times[-1]}
        assert {r["n"] for r in got if r["k"] == key} == {len(times)}


def test_values_at_ranks_with_weights(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (5.0, 6)], "v DOUBLE, w INT").withColumn("bin", F.floor("v"))
    got = values_at_ranks(df, [], ["bin"], "v", lambda n: [F.lit(i) for i in range(10)], weight="w")
    assert [r["value"] for r in got.orderBy("slot").collect()] == [1.0] * 3 + [2.0] + [5.0] * 6


def test_latest_by_key_keeps_nulls_of_the_last_row(spark):
    df = spark.createDataFrame(
        [("a", 1, "x", 1.0), ("a", 3, None, 3.0), ("a", 2, "y", 2.0), ("b", 1, "z", None)],
        "k STRING, seq INT, s STRING, v DOUBLE",
    )
    got = {r["k"]: (r["seq"], r["s"], r["v"]) for r in latest_by_key(df, "k", "seq").collect()}
    assert got == {"a": (3, None, 3.0), "b": (1, "z", None)}


def test_merge_fields_keeps_earlier_values(spark):
    df = spark.createDataFrame(
        [("a", 1, "x", None), ("a", 2, None, 2.0), ("a", 3, None, None), ("b", 1, None, None)],
        "k STRING, seq INT, s STRING, v DOUBLE",
    )
    got = {r["k"]: (r["s"], r["v"]) for r in merge_fields(df, "k", "seq").collect()}
    assert got == {"a": ("x", 2.0), "b": (None, None)}


def test_mode_ties_go_to_the_value_seen_first(spark):
    df = spark.createDataFrame(
        [("u", "VISA", 9), ("u", "AMEX", 1), ("u", "VISA", 2), ("u", "AMEX", 5), ("w", "B", 4), ("w", "A", 4)],
        "user STRING, card STRING, t INT",
    )
    got = {r["user"]: r["card"] for r in most_frequent(df, "user", "card", "t").collect()}
    assert got == {"u": "AMEX", "w": "A"}
