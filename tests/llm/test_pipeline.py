"""The stages on the smallest tables: columns, decisions taken, and the registered queries' keys."""

from pyspark.sql import functions as F

import corpus_pipeline
from txnscore.llm import decontam, jaccard, mix, secrets
from txnscore.llm.queries import ORACLES, QUERIES


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, small).cache()
        assert after.columns == columns, name
        assert 0 < after.count() <= before.count()
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        before = after
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    assert decontam.contaminated(before, benchmark).count() == 0
    assert secrets.scan(before).where(F.size("secrets") > 0).count() == 0
    assert jaccard.near_duplicates(before).where("doc_id <> component_id").count() == 0
    marked = before.join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id")
    assert marked.where("quality = 0").count() <= 0.1 * marked.count()
    assert before.where("n_chars <> char_length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, before, small)
    assert last.count() == before.count()


def test_run_gives_the_last_stage(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert {"doc_id", "size", "target", "taken"} <= set(got.columns)
    assert got.count() == got.select("doc_id").distinct().count()
    # A source of a few documents is filled to less than its smallest one left out.
    largest = got.groupBy("source").agg(F.max("size").alias("n")).agg(F.sum("n")).first()[0]
    total, taken = got.agg(F.sum("size"), F.sum("taken")).first()
    assert 0 <= total - taken < largest


def test_mixing_takes_no_document_more_than_thrice(spark, small):
    got = mix.plan(spark.read.parquet(f"{small}/documents.parquet"))
    assert got.where("taken > 3 * size OR taken < 0").count() == 0


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def stage_tables(spark, folder, rows):
    """documents as given, with labels and benchmark."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.col("doc_id")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, ITEM), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


ITEM = "which river runs through the old town of the north? the river that never freezes in any winter"
ODD = [
    (1, "plain words " * 10, "en", "a", 120), (1, "plain words " * 10, "en", "a", 120), (2, "plain words " * 10, "en", "b", 120),
    (3, None, None, None, None), (4, "", "en", None, 0), (5, " \t\n", "en", "a", 3), (None, "no id at all here", "en", "a", None),
    (6, "before " + ITEM + " after", "en", "b", 100), (7, "password = hunter2hunter2", "en", "b", 25), (8, "x " * 400_000, "en", "a", 800_000),
]


def test_stages_on_odd_rows(spark, tmp_path):
    """NULL, empty and blank texts, NULL ids and sources, repeated and tied rows, a long text, an extra column."""
    import corpus_pipeline as cp

    folder = str(tmp_path / "sf")
    stage_tables(spark, folder, ODD)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = cp.good_quality(spark, docs, folder)
    assert kept.count() == len(ODD) and kept.columns == docs.columns
    one = cp.one_of_each(spark, kept, folder)
    assert sorted((r["doc_id"] for r in one.collect()), key=str) == sorted([1, 3, 4, 5, None, 6, 7, 8], key=str)
    clean = cp.without_benchmark(spark, one, folder)
    assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted([1, 3, 4, 5, None, 7, 8], key=str)
    masked = {r["doc_id"]: r for r in cp.without_secrets(spark, clean, folder).collect()}
    assert masked[7]["text"] == "[SECRET]" and masked[7]["n_chars"] == 8
    assert masked[3]["text"] is None and masked[3]["n_chars"] is None and masked[None]["n_chars"] is None
    assert "n_chars" not in cp.without_secrets(spark, clean.drop("n_chars"), folder).columns
    taken = {r["doc_id"]: r["taken"] for r in cp.mixed(spark, clean, folder).collect()}
    assert set(taken) == set(masked) and taken[3] == taken[4] == taken[5] == 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    folder = str(tmp_path / "sf")
    stage_tables(spark, folder, [])
    assert cp.run(spark, folder).collect() == []
