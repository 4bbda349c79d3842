"""From raw JSON to a model, a scoring stream, statistics and clean-up."""

import json
import random

import pytest
from pyspark.sql import functions as F

from txnscore import jobs
from txnscore.config import Settings
from txnscore.functions.messages import decode_messages
from txnscore.ml.model import category_table, encoded_input, encoding_stages, probability, scaler_fit, train
from txnscore.ml.registry import ModelRegistry
from txnscore.plans.results import latest_predictions, search_profiles, search_transactions
from txnscore.schemas import MODEL_FEATURES
from txnscore.sources import readers
from txnscore.sources.batches import BatchTable
from txnscore.sources.runlog import RunLog
from txnscore.streaming.tail import drain

SETTINGS = Settings(num_trees=8, max_depth=5)
START = 1_704_067_200


def raw_rows(n=900):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        t = START + rng.randrange(40 * 86400)
        row = {
            "transaction_id": f"t{i}", "user_id": f"u{rng.randrange(12)}", "merchant_id": f"m{rng.randrange(5)}",
            "item_name": "blue lamp" if i % 2 else "red chair", "amount": rng.randrange(100, 90000) / 100,
            "currency": "USD", "lat": 40.5, "lon": -74.25, "card_provider": rng.choice(["VISA", "AMEX"]),
            "timestamp": f"2024-01-{1 + i % 28:02d}T10:00:00" if i % 3 == 0 else t,
        }
        if i % 10 == 0:
            row["location"] = "2.25,48.5"
        rows.append(row)
    return rows


def message(i, run="run-1"):
    return json.dumps({
        "transaction_id": f"live{i}", "user_id": f"u{i % 15}", "merchant_id": f"m{i % 6}", "amount": 20.0 * (i % 70),
        "currency": "USD", "timestamp": START + 45 * 86400 + i, "card_provider": "VISA", "location": "-74.25,40.5",
        "run_id": run, "is_fraud": i % 2, "synthetic": 1,
    })


@pytest.fixture(scope="module")
def deployed(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("deployment")
    raw = base / "raw.json"
    raw.write_text(json.dumps(raw_rows()))
    root = str(base / "root")
    version, metrics = jobs.prepare(spark, str(raw), root, SETTINGS)
    return root, version, metrics.first().asDict()


def write_feed(spark, path, groups):
    for i, lines in enumerate(groups):
        spark.createDataFrame([(x,) for x in lines], "data STRING").coalesce(1).write.mode("append").parquet(path)


def worker(spark, root, feed, version=None):
    query = jobs.start_worker(spark, root, feed, version, "w1", SETTINGS, available_now=True, files_per_trigger=1)
    assert query.awaitTermination(300)
    assert query.exception() is None


def test_prepare(spark, deployed):
    root, version, metrics = deployed
    assert metrics["rows"] == 180 and metrics["accuracy"] > 0.5
    training = spark.read.parquet(f"{root}/training")
    assert training.filter("is_fraud = 1").count() == int(900 * 0.15)
    assert set(MODEL_FEATURES) <= set(training.columns)
    history = spark.read.parquet(f"{root}/history")
    assert {r[0] for r in history.select("location").distinct().collect()} == {"2.25,48.5", "-74.25,40.5"}
    assert [r["version"] for r in ModelRegistry(spark, root, SETTINGS.model_name).versions().collect()] == [version]


def test_registry_is_loud(spark, deployed, tmp_path):
    root, version, _ = deployed
    registry = ModelRegistry(spark, root, SETTINGS.model_name)
    assert registry.load(version).stages.stages
    with pytest.raises(LookupError):
        registry.load("no-such-version")
    with pytest.raises(LookupError):
        ModelRegistry(spark, str(tmp_path)).load()


def test_missing_features_are_refused(spark, deployed):
    model = jobs.scoring_job(spark, deployed[0], settings=SETTINGS).model
    with pytest.raises(ValueError, match="transaction_velocity"):
        probability(spark.createDataFrame([(1.0,)], "amount DOUBLE"), model)


def test_unseen_category_encodes_as_zeros(spark, deployed):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rows = spark.read.parquet(f"{deployed[0]}/training")
    categories, scaler = category_table(rows), scaler_fit(rows)
    fitted = Pipeline(stages=encoding_stages()).fit(encoded_input(rows, categories, scaler))
    odd = rows.limit(1).withColumns({"merchant_id": F.lit("never seen"), "card_provider": F.lit("new")})
    x = fitted.transform(encoded_input(odd, categories, scaler)).select(vector_to_array("features")).first()[0]
    assert sum(x[8:]) == 4.0


def test_places_are_those_of_one_sort(spark):
    """Numbers given range by range equal a row number over the whole column."""
    rng = random.Random(3)
    rows = spark.createDataFrame([(f"c{int(rng.paretovariate(0.7)) % 500}", f"m{rng.randrange(40)}") for _ in range(4000)], "card_provider STRING, merchant_id STRING")
    rows = rows.withColumns({c: F.lit("x") for c in ("amount_category", "user_segment", "is_preferred_card", "is_home_location")})
    found = category_table(rows.repartition(9)).collect()
    for feature in ("card_provider", "merchant_id"):
        counts = {}
        for r in rows.select(feature).collect():
            counts[r[0]] = counts.get(r[0], 0) + 1
        want = {c: k for k, (_, c) in enumerate(sorted((-n, c) for c, n in counts.items()))}
        assert {r["category"]: r["place"] for r in found if r["feature"] == feature} == want


def test_very_many_merchants_train(spark, deployed):
    rows = spark.read.parquet(f"{deployed[0]}/training").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(27))))
    ident = F.concat("transaction_id", F.lit("-"), F.col("n").cast("string"))
    many = rows.withColumns({"merchant_id": F.concat(F.lit("m"), ident), "transaction_id": ident})
    trained = train(many, Settings(num_trees=1, max_depth=2))
    assert trained.model.categories.filter("feature = 'merchant_id'").count() > 20_000
    assert trained.metrics.first()["rows"] == 900 * 28 * 0.2


def test_training_reports_classes_and_confusion(spark, deployed):
    trained = train(spark.read.parquet(f"{deployed[0]}/training"), SETTINGS)
    report = {r["class"]: r for r in trained.report.collect()}
    cells = {r["label"]: r for r in trained.confusion.collect()}
    metrics = trained.metrics.first()
    assert report["accuracy"]["precision"] == metrics["accuracy"]
    assert report["0"]["support"] + report["1"]["support"] == metrics["rows"]
    assert (cells[1]["predicted_1"], cells[0]["predicted_1"]) == (metrics["tp"], metrics["fp"])


def test_deliveries_that_cannot_be_used_are_kept_apart(spark, tmp_path):
    lines = [
        '{"transaction_id": "a", "user_id": "u", "amount": 10, "timestamp": 1704067300.5}',
        '{"transaction_id": "b", "user_id": "u", "amount": NaN, "timestamp": 1704067301}',
        '{"user_id": "u", "amount": 1, "timestamp": 1704067302}',
        '{"transaction_id": "c", "amount": 1, "timestamp": 1704067303}',
        '{"transaction_id": "d", "user_id": "u", "amount": 1, "timestamp": "soon"}',
        '{"transaction_id": "e", "user_id": "u", "amou',
        '{"transaction_id": "a", "user_id": "u", "amount": "x", "timestamp": 1704067304}',
    ]
    (tmp_path / "raw.json").write_text("\n".join(lines))
    raw = readers.read_raw_json(spark, str(tmp_path / "raw.json"), multiline=False, arrival=True)
    root = str(tmp_path / "root")
    jobs.load(spark, raw, root, readers.ARRIVAL)
    history = spark.read.parquet(f"{root}/history").collect()
    assert [(r["transaction_id"], r["timestamp"]) for r in history] == [("a", 1704067300)]
    reasons = sorted(r["reason"] for r in spark.read.parquet(f"{root}/rejected_history").collect())
    assert reasons == sorted(["unusable amount", "no transaction id", "no user", "unreadable time", "malformed", "malformed"])
    assert spark.read.parquet(f"{root}/profiles").first()["first_seen"] == 1704067300


def test_stream_equals_batch_and_survives_restart(spark, deployed, tmp_path):
    source, version, _ = deployed
    root = str(tmp_path / "stream")
    for table in ("serving_history", "profiles", "models", "model_registry"):
        import shutil

        shutil.copytree(f"{source}/{table}", f"{root}/{table}")
    feed = str(tmp_path / "feed")
    bad = [
        "{broken", None, '{"transaction_id": "z", "timestamp": 99999999999999999999}',
        '{"transaction_id": "y", "user_id": "u1", "amount": NaN, "timestamp": 1704067300}',
    ]
    write_feed(spark, feed, [[message(i) for i in range(0, 40)], [message(i) for i in range(40, 70)] + bad])
    worker(spark, root, feed, version)
    before = jobs.predictions(spark, root).count()
    assert before == 70
    # New files after a restart: later messages, one redelivery, one without a run.
    late = [message(i, "run-2") for i in range(70, 90)] + [message(3)] + [message(95).replace('"run_id": "run-1", ', "")]
    write_feed(spark, feed, [late])
    worker(spark, root, feed, version)
    stored = jobs.predictions(spark, root)
    assert stored.count() == 70 + 22
    streamed = latest_predictions(stored, ["processed_at", "batch_id", "arrival"])
    assert streamed.count() == 91

    job = jobs.scoring_job(spark, root, version, worker_id="w1", settings=SETTINGS)
    batch = job.predict(decode_messages(spark.read.parquet(feed).distinct()))
    columns = ["transaction_id", "amount", "user_id", "is_fraud", "label", "fraud_probability"]
    assert sorted(map(tuple, streamed.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))

    dead = {r["data"]: r["reason"] for r in jobs.dead_letters(spark, root).collect()}
    assert dead == {"{broken": "malformed", None: "no payload", bad[2]: "unreadable time", bad[3]: "unusable amount"}
    runs = {r["run_id"] for r in jobs.stats_events(spark, root).select("run_id").distinct().collect()}
    assert runs == {"run-1", "run-2", "unknown"}
    sizes = sorted(r["transactions"] for r in jobs.batch_stats(spark, root).collect())
    assert sizes == [22, 30, 40]
    # A committed batch is left as it is when it is tried again; one stored copy of every message.
    job.process(spark.createDataFrame([(message(i),) for i in range(40)], "data STRING"), 0)
    assert jobs.predictions(spark, root).filter("batch_id = 0").count() == 40
    assert spark.read.parquet(f"{root}/scored/rows").count() == 70 + 22 + len(bad)
    progress = jobs.stream_progress(spark, root).orderBy("batch_id").collect()
    assert [r["messages_so_far"] for r in progress] == [40, 40 + 30 + 4, 40 + 30 + 4 + 22]
    assert [r["dead"] for r in progress] == [0, 4, 0]

    # A second query on its own feed keeps its output apart.
    other_feed = str(tmp_path / "feed2")
    write_feed(spark, other_feed, [[message(i, "run-3") for i in range(200, 205)]])
    second = jobs.start_worker(spark, root, other_feed, version, "w2", SETTINGS, available_now=True)
    assert second.awaitTermination(300)
    events = jobs.stats_events(spark, root)
    assert {(r["worker_id"], r["source"]) for r in events.select("worker_id", "source").distinct().collect()} == {
        ("w1", "w1"), ("w2", "w2")}
    assert events.filter("worker_id = 'w1'").count() == 92

    log = RunLog(spark, f"{root}/runs")
    log.start("run-1", "wave", 10.0, 0.2, 2)
    log.complete("run-1", transactions=70)
    log.start("run-2")
    log.update("run-2", pattern="spike")
    listed = jobs.list_runs(spark, root).collect()
    assert [r["run_id"] for r in listed] == ["run-2", "run-1"]
    assert [(r["pattern"], r["complete"]) for r in listed] == [("spike", False), ("wave", True)]
    stats = jobs.run_stats(spark, root, "run-1").first()
    assert stats["worker_ids"] == "w1"
    assert jobs.run_stats(spark, root).first()["run_id"] == "run-2"
    assert jobs.run_stats(spark, root, "run-2").first()["transactions"] == 20
    jobs.export_run_stats(spark, root, str(tmp_path / "json"), "run-2")
    assert json.loads(spark.read.text(str(tmp_path / "json")).first()[0])["transactions"] == 20
    newest = jobs.latest_results(spark, root, 5).collect()
    assert len(newest) == 5 and {r["run_id"] for r in newest} == {"run-3"}
    assert jobs.latest_results(spark, root, 100, "run-2").count() == 20

    tail = lambda: jobs.follow_results(spark, root, str(tmp_path / "seen"), str(tmp_path / "position"), "run-2")
    assert tail().count() == 20
    assert tail().count() == 20

    jobs.snapshot_workers(spark, root)
    newest_at = jobs.stats_events(spark, root).agg(F.max("timestamp")).first()[0]
    jobs.expire(spark, root, F.lit(newest_at), SETTINGS)
    assert jobs.stats_events(spark, root).count() == 97
    later = F.lit(newest_at) + F.expr("INTERVAL 25 HOURS")
    jobs.expire(spark, root, later, SETTINGS)
    assert jobs.worker_stats(spark, root).count() == 0 and jobs.predictions(spark, root).count() == 97
    kept = {(r["run_id"], r["worker_id"]): r["transactions"] for r in jobs.stored_workers(spark, root).collect()}
    assert kept[("run-2", "w1")] == 20
    jobs.expire_workers(spark, root, later, SETTINGS)
    assert jobs.stored_workers(spark, root).count() == 0

    left = {r["table"]: r["rows"] for r in jobs.purge(spark, root, ("predictions",)).collect()}
    assert left == {"predictions": 0}
    assert jobs.result_messages(spark, root).count() == 97
    with pytest.raises(ValueError):
        jobs.purge(spark, root, ("everything",))


def test_json_lines_and_arrays_read_alike(spark, tmp_path):
    rows = raw_rows(30)
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "l.json").write_text("\n".join(json.dumps(r) for r in rows))
    a = readers.scan_json_transactions(spark, str(tmp_path / "a.json"))
    b = readers.scan_json_transactions(spark, str(tmp_path / "l.json"), multiline=False)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert {r[0] for r in a.select("location").collect()} == {"-74.25,40.5"}


def test_search(spark, deployed):
    history = spark.read.parquet(f"{deployed[0]}/history")
    found = search_transactions(
        history, tags={"user_id": "u3"}, ranges={"amount": (100, None)}, text={"item_name": "Blue lamp"},
        order_by=[("amount", True)], limit=5,
    ).collect()
    assert found and all(r["user_id"] == "u3" and r["item_name"] == "blue lamp" for r in found)
    assert [r["amount"] for r in found] == sorted((r["amount"] for r in found), reverse=True)
    assert search_transactions(history, near=(2.25, 48.5, 1.0)).count() == 90
    profiles = spark.read.parquet(f"{deployed[0]}/profiles")
    assert search_profiles(profiles, near=(-74.25, 40.5, 5.0)).count() == profiles.count()


def test_settings_from_environment():
    assert Settings.from_env({"TXNSCORE_FRAUD_THRESHOLD": "0.5", "TXNSCORE_NUM_TREES": "7"}).num_trees == 7
    assert Settings.from_env({}).fraud_threshold == 0.7


def test_fresh_model_scores_in_a_session_with_observations(spark, deployed):
    from pyspark.sql import Observation

    seen = Observation("rows")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    trained = train(spark.read.parquet(f"{deployed[0]}/training"), SETTINGS)
    assert trained.test.count() == 180


def test_command_line(spark, deployed, tmp_path, capsys, monkeypatch):
    from txnscore.__main__ import main

    root, version, _ = deployed
    feed = str(tmp_path / "feed")
    write_feed(spark, feed, [[message(i, "run-9") for i in range(12)]])
    RunLog(spark, f"{root}/runs").start("run-9", "wave", 5.0)
    main(["--root", root, "worker", feed, "--once", "--worker-id", "cli", "--model-version", version])
    main(["--root", root, "monitor", "runs"])
    main(["--root", root, "monitor", "latest", "--run-id", "run-9", "--count", "3"])
    main(["--root", root, "monitor", "workers", "--run-id", "run-9"])
    main(["--root", root, "monitor", "stats", "--json", str(tmp_path / "json")])
    shown = capsys.readouterr().out
    assert "run-9" in shown and "wave" in shown and "In Progress" in shown and "cli" in shown
    text = jobs.run_stats_text(spark, root, "run-9")
    assert json.loads(text)["transactions"] == 12 and "\n" in text
    assert jobs.run_stats_text(spark, root, "nope") is None
    main(["--root", root, "cleanup", "predictions"])
    assert jobs.predictions(spark, root).count() == 0
    assert jobs.latest_results(spark, root, 50).count() == 12
    with pytest.raises(ValueError):
        main(["--root", root, "cleanup", "history"])


def batch(spark, n=5, run="r"):
    return spark.range(n).select(F.col("id").cast("string").alias("transaction_id"), F.lit(run).alias("run_id"))


def put(table, number, at, rows=None, source="w1"):
    rows = batch(table.spark) if rows is None else rows
    attempt = table.write(rows, source, number, at)
    return table.commit(source, number, attempt, messages=rows.count())


DAY = 86_400_000_000
NOON = 1_700_000_000_000_000


def test_a_purged_view_takes_new_batches(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "scored"))
    put(table, 0, NOON)
    assert jobs.purge(spark, str(tmp_path), ("predictions",)).first()["rows"] == 0
    put(table, 1, NOON + 5)
    assert [r["batch_id"] for r in table.rows("predictions").select("batch_id").distinct().collect()] == [1]
    assert table.rows("results").count() == 10


def test_a_retried_batch_is_seen_once(spark, tmp_path):
    """An attempt fails after writing, its batch is tried again between two drains, then once more."""
    table = BatchTable(spark, str(tmp_path / "t"))
    tail = lambda: drain(table, lambda rows: rows, str(tmp_path / "seen"), str(tmp_path / "position"), files_per_trigger=1)
    assert tail_is_empty(table, tmp_path)
    put(table, 0, NOON)
    table.write(batch(spark, 7), "w1", 1, NOON + 1)
    assert tail().count() == 5
    assert put(table, 1, NOON + 2, batch(spark, 7))
    assert tail().count() == 12
    assert not put(table, 1, NOON + DAY, batch(spark, 7))
    assert tail().count() == 12 and table.rows().count() == 12
    assert tail().groupBy("batch_id").count().count() == 2


def tail_is_empty(table, tmp_path):
    table.write(batch(table.spark), "other", 0, NOON)
    return drain(table, lambda rows: rows, str(tmp_path / "seen"), str(tmp_path / "position")).count() == 0


def test_newest_rows_read_only_the_last_folders(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"))
    for k in range(12):
        put(table, k, NOON + k, batch(spark, 5, "rare" if k == 3 else "r"))
    files = lambda df: len(df.inputFiles())
    assert files(table.newest(lambda rows: rows, 4)) <= files(table.newest(lambda rows: rows, 18)) < files(table.rows())
    assert table.newest(lambda rows: rows, 4).select("batch_id").distinct().collect()[0][0] == 11
    rare = table.newest(lambda rows: rows.filter("run_id = 'rare'"), 3)
    assert rare.count() == 5
    assert table.newest(lambda rows: rows.filter("run_id = 'none'"), 3).count() == 0


def test_days_that_no_view_shows_are_removed(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"))
    for k in range(3):
        put(table, k, NOON + k * DAY)
    table.set_mark("a", NOON + 2 * DAY)
    assert table.sweep(["a", "b"]) == []
    table.set_mark("b", NOON + DAY)
    assert len(table.sweep(["a", "b"])) == 1
    assert {r[0] for r in table.rows().select("batch_id").distinct().collect()} == {1, 2}
    table.set_mark("a", NOON)
    assert table.mark("a") == NOON + 2 * DAY
    assert put(table, 3, NOON + 3 * DAY) and table.rows("a").count() == 10


def test_old_runs_expire(spark, tmp_path):
    root = str(tmp_path)
    log = RunLog(spark, f"{root}/runs")
    log.start("old")
    log.complete("old", transactions=3)
    log.start("busy")
    # The clock has moved on by a day and a half; one run is still at work.
    log.log.rewrite(lambda rows: rows.withColumn("seq", F.col("seq") - 36 * 3600 * 1_000_000))
    log.start("new")
    assert sorted(r["run_id"] for r in jobs.expire_runs(spark, root, F.current_timestamp(), SETTINGS).collect()) == ["busy", "old"]
    assert [r["run_id"] for r in log.runs().collect()] == ["new"]


def test_an_update_during_expiry_survives(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    log.start("a")
    log.start("b")

    def keep(rows):
        log.update("a", pattern="spike")
        log.start("c")
        return rows.filter("run_id = 'b'")

    log.log.rewrite(keep)
    assert {r["run_id"]: r["pattern"] for r in log.runs().collect()} == {"a": "spike", "b": "constant", "c": "constant"}


def test_of_two_rewrites_one_starts_again(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    for run in "abc":
        log.start(run)
    calls = []

    def drop_a(rows):
        calls.append(1)
        if len(calls) == 1:
            log.log.rewrite(lambda r: r.filter("run_id <> 'b'"))
        return rows.filter("run_id <> 'a'")

    log.log.rewrite(drop_a)
    assert len(calls) == 2 and [r["run_id"] for r in log.runs().collect()] == ["c"]
    log.log.rewrite(lambda rows: rows)
    log.log.vacuum()
    assert [r["run_id"] for r in log.runs().collect()] == ["c"] and log.log.folder.names("parts") == []
    assert len(log.log.folder.names("versions")) == 2
