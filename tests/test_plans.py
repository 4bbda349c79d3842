"""Physical shapes that matter at scale."""

import contextlib
import re

import pytest

from __spark_entry__ import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def initial(df):
    text = plan(df)
    return text.split("Initial Plan")[-1]


LAZY = sorted(
    set(queries())
    - {"train_eval", "score_batch", "model_versions", "stream_score", "stream_dead_letters", "batch_stats",
       "live_worker_stats", "encoded_features", "purge", "tail_results", "tail_latency"}
)


@pytest.mark.parametrize("name", LAZY)
def test_no_pairs_and_no_python(name, spark, small):
    text = plan(queries()[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Python|Pandas|ArrowEval", text)


def test_offline_features_shuffle_the_payload_once(spark, small):
    with without_broadcast(spark):
        text = initial(queries()["offline_features"](spark, small))
    payload = [line for line in text.splitlines() if "FileScan" in line and "props" in line]
    assert len(payload) == 1
    assert "SinglePartition" not in text
    # No exchange by the user alone carries rows: only day totals and profile votes do.
    assert len(re.findall(r"Exchange hashpartitioning\(user_id#\d+, timestamp#\d+L?, \d+\)", text)) >= 2


def test_windows_of_hot_keys_are_bucketed(spark, small):
    text = plan(queries()["serving_features"](spark, small))
    for window in re.findall(r"windowspecdefinition\(([^)]*)", text):
        assert "day#" in window


@contextlib.contextmanager
def without_broadcast(spark):
    """Small tables would be broadcast; this shows the shapes large ones get."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_latest_n_is_cut_before_the_shuffle(spark, small):
    text = initial(queries()["recent_transactions"](spark, small))
    assert re.search(r"Exchange hashpartitioning.*\n.*WindowGroupLimit.*Partial", text)


def test_user_lookup_reaches_the_scan(spark, small, tmp_path):
    from txnscore.plans.results import user_history

    queries()["parquet_round_trip"](spark, small).write.parquet(str(tmp_path / "t"))
    text = plan(user_history(spark.read.parquet(str(tmp_path / "t")), "USER7"))
    assert "EqualTo(user_id,USER7)" in text


def _job(spark, path, **options):
    from txnscore.sources.stored import read_by_user, save_by_user
    from txnscore.streaming.score import ScoringJob

    rows = spark.range(60_000).selectExpr("concat('u', id % 3000) AS user_id", "id AS timestamp", "1L AS txns", "1 AS spend")
    save_by_user(rows, path, 4, within="timestamp", **options)
    return ScoringJob(None, read_by_user(spark, path), read_by_user(spark, path), "")


def test_recent_history_filter_reaches_the_scan(spark, tmp_path):
    job = _job(spark, str(tmp_path / "h"))
    asked = spark.createDataFrame([("u7", 9_000_000)], "user_id STRING, timestamp BIGINT")
    reach = job._reach(asked)
    assert (reach["rows"], reach["oldest"], reach["named"]) == (1, 9_000_000, ["u7"]) and len(reach["history"]) == 1
    text = plan(job.recent(reach))
    assert "GreaterThanOrEqual(timestamp" in text and "user_bucket" in re.search(r"PartitionFilters: .*", text)[0]
    assert "u7" in re.search(r"PushedFilters: .*", text)[0]


def test_bloom_filters_skip_row_groups(spark, tmp_path):
    """A user's bucket has many row groups; only those that may hold the user are read."""
    job = _job(spark, str(tmp_path / "h"), parquet__block__size="4096", parquet__page__size="1024", parquet__block__size__row__check__min="100")
    user = spark.range(1).selectExpr("'u7' AS user_id", "99L AS timestamp")
    reach = job._reach(user)
    found = job.history.of(reach["history"], reach["named"])
    assert found.count() == 20
    whole = job.history.of(reach["history"])
    rows = [_scanned(df) for df in (found, whole)]
    assert rows[0] < rows[1]


def _scanned(df):
    """Rows that the scan of a plan gave on."""
    df = df.select("user_id", "timestamp")
    df.collect()
    scans = [df._jdf.queryExecution().executedPlan()]
    while scans[0].children().size():
        scans = [scans[0].children().apply(0)]
    return scans[0].metrics().apply("numOutputRows").value()


def test_layout_is_that_of_the_table(spark, tmp_path, monkeypatch):
    """The number of buckets in the settings is for writing only."""
    monkeypatch.setenv("TXNSCORE_USER_BUCKETS", "7")
    job = _job(spark, str(tmp_path / "h"))
    assert job.history.buckets == 4
    reach = job._reach(spark.range(300).selectExpr("concat('u', id) AS user_id", "1L AS timestamp"))
    assert reach["named"] is None
    assert job.recent(reach).filter("user_id IN ('u3', 'u299')").count() == 40


@pytest.mark.parametrize("name", ["fraud_labels", "stratified_split", "roc_auc", "latency_stats"])
def test_single_partitions_hold_counts_only(name, spark, small):
    """Whatever meets in one task was aggregated first."""
    text = initial(queries()[name](spark, small))
    for found in re.findall(r"Exchange SinglePartition.*\n(.*)", text):
        assert re.search(r"HashAggregate|SortAggregate|Project", found)
