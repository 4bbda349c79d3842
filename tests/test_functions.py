"""Edge cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from txnscore.functions import features as fx
from txnscore.functions import report as rx
from txnscore.functions.messages import dead_letters, decode_messages, parse_messages


def one_column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, x {kind}")


def mapped(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_epoch_seconds(spark):
    texts = ["1704067200", "2024-01-01T00:00:00", "2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "", "0", None, "soon"]
    got = mapped(one_column(spark, texts, "STRING"), fx.epoch_seconds(F.col("x")))
    assert got == [1704067200] * 4 + [None, 0, None, None]


def test_amount_category(spark):
    amounts = [-1.0, 0.0, 0.01, 100.0, 100.01, 500.0, 500.01, 1000.0, 1000.01, None]
    rows = one_column(spark, amounts, "DOUBLE")
    tail = ["low", "low", "medium", "medium", "high", "high", "very_high", None]
    assert mapped(rows, fx.amount_category(F.col("x"), True)) == [None, None, *tail]
    assert mapped(rows, fx.amount_category(F.col("x"), False)) == ["low", "low", *tail]


def test_calendar_before_and_after_the_epoch(spark):
    import datetime

    stamps = [0, -1, 1704067199, 1704067200, 951782400, -86400 * 3 + 5]
    rows = one_column(spark, stamps, "BIGINT")
    at = [datetime.datetime.fromtimestamp(s, datetime.timezone.utc) for s in stamps]
    assert mapped(rows, fx.hour_of_day(F.col("x"))) == [t.hour for t in at]
    assert mapped(rows, fx.day_of_week(F.col("x"))) == [t.weekday() for t in at]
    assert mapped(rows, fx.weekend_flag(F.col("x"))) == [int(t.weekday() >= 5) for t in at]


@pytest.mark.parametrize(
    "here, home, expected",
    [
        ("1.5,2.5", "1.5,2.5", True),
        ("0.0899,45", "0,45", True),
        ("0.0901,45", "0,45", False),
        (" 1.5 , 2.5 ", "1.5,2.5", True),
        ("1,2", "0,0", False),
        ("", "1,2", False),
        (None, "1,2", False),
        ("1,2,3", "1,2", False),
        ("a,b", "1,2", False),
        ("1,2", None, False),
    ],
)
def test_near_home(spark, here, home, expected):
    row = spark.createDataFrame([(here, home)], "a STRING, b STRING")
    assert row.select(fx.near_home(F.col("a"), F.col("b"))).first()[0] is expected


def test_segment_edges(spark):
    rows = one_column(spark, [5000.0, 5000.01, 1000.0, 1000.01, 0.0], "DOUBLE")
    assert mapped(rows, fx.spend_segment(F.col("x"))) == ["STANDARD", "PREMIUM", "BASIC", "STANDARD", "BASIC"]


def test_duration_text(spark):
    rows = one_column(spark, [0.0, 12.34, 59.0, 60.0, 184.5, 3600.0, 3723.4], "DOUBLE")
    assert mapped(rows, rx.duration_text(F.col("x"))) == [
        "0.0s", "12.3s", "59.0s", "1m 0.0s", "3m 4.5s", "1h 0m 0.0s", "1h 2m 3.4s",
    ]


def test_bands_and_status(spark):
    rows = one_column(spark, [50.0, 50.1, 100.0, 100.1, 500.0, 500.1], "DOUBLE")
    assert mapped(rows, rx.latency_band(F.col("x"))) == ["green", "yellow", "yellow", "red", "red", "red"]
    assert mapped(rows, rx.tps_band(F.col("x"))) == ["red", "red", "red", "yellow", "yellow", "green"]
    flags = one_column(spark, [True, False], "BOOLEAN")
    assert mapped(flags, rx.run_status(F.col("x"))) == ["Complete", "In Progress"]
    assert mapped(flags, rx.worker_mode(F.col("x"))) == ["Parallel", "Sequential"]


def test_iso_text_round_trip(spark):
    rows = spark.sql("SELECT 0 AS i, TIMESTAMP '2024-01-02 03:04:05' AS x UNION ALL SELECT 1, TIMESTAMP '2024-01-02 03:04:05.000678'")
    assert mapped(rows, rx.iso_text(F.col("x"))) == ["2024-01-02T03:04:05", "2024-01-02T03:04:05.000678"]


def test_half_up(spark):
    rows = one_column(spark, [0.125, 0.375, 2.0, None], "DOUBLE")
    assert mapped(rows, fx.half_up(F.col("x"), 2)) == [0.13, 0.38, 2.0, None]


MESSAGES = [
    '{"transaction_id":"a","user_id":"U","amount":5.5,"timestamp":1704067200,"run_id":"r"}',
    '{"transaction_id":"b","user_id":"U","amount":1,"timestamp":"2024-01-01T00:00:00","extra":[1]}',
    '{"transaction_id":"c","user_id":"U"}',
    '{"transaction_id":"d","amount":"many"}',
    "not json",
    None,
    "",
    '{"init":"reset"}',
    '{"transaction_id":"a","amount":6}',
    '[{"transaction_id":"a","amount":6}]',
    '{"transaction_id":"e","timestamp":"soon"}',
    '{"transaction_id":"f","timestamp":9223372036854775807}',
    '{"transaction_id":"g","is_fraud":true,"synthetic":"odd"}',
    "null",
]


def test_messages_are_decoded_or_routed(spark):
    rows = one_column(spark, MESSAGES, "STRING").withColumnRenamed("x", "data")
    good = {r["i"]: r for r in decode_messages(rows).collect()}
    bad = {r["i"]: r["reason"] for r in dead_letters(parse_messages(rows)).collect()}
    assert sorted(good) == [0, 1, 2, 7, 8, 12]
    assert good[0]["timestamp"] == good[1]["timestamp"] == 1704067200
    assert good[2]["amount"] is None
    assert good[7]["transaction_id"] is None
    assert (good[12]["is_fraud"], good[12]["synthetic"]) == (1, None)
    assert bad == {
        3: "malformed", 4: "malformed", 5: "no payload", 6: "no payload", 9: "malformed",
        10: "unreadable time", 11: "unreadable time", 13: "malformed",
    }
