"""The node table says what the model does: DuckDB walks it, row by row and tree by tree."""

import re

import duckdb
import pytest

from txnscore.config import Settings
from txnscore.ml import model as ml
from txnscore.ml.forest import NODES, node_table, walk
from txnscore.plans.history import offline_features
from txnscore.plans.labels import add_fraud_labels
from txnscore.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from txnscore.session import materialize

WALK = """
WITH RECURSIVE raw AS (FROM read_parquet('{rows}/*.parquet')),
numbers AS (UNPIVOT (SELECT transaction_id, {numbers} FROM raw) ON {names} INTO NAME feature VALUE x),
scaled AS (SELECT transaction_id, n.feature, (x - mean) / CASE WHEN std > 0 THEN std ELSE 1 END AS x
  FROM numbers n JOIN read_parquet('{scaler}/*.parquet') s ON s.feature = n.feature),
texts AS (UNPIVOT (SELECT transaction_id, {texts} FROM raw) ON {kinds} INTO NAME feature VALUE category),
placed AS (SELECT transaction_id, t.feature, c.place FROM texts t LEFT JOIN read_parquet('{categories}/*.parquet') c
  ON c.feature = t.feature AND c.category = t.category),
nodes AS (FROM read_parquet('{nodes}/*.parquet')),
steps AS (
  SELECT transaction_id, tree, 0 AS node, false AS done FROM raw, (SELECT DISTINCT tree FROM nodes)
  UNION ALL
  SELECT s.transaction_id, s.tree,
    CASE WHEN (n.place IS NULL AND x <= threshold) OR (n.place IS NOT NULL AND p.place IS DISTINCT FROM n.place) THEN n."left" ELSE n."right" END,
    false
  FROM steps s JOIN nodes n ON n.tree = s.tree AND n.node = s.node AND n."left" IS NOT NULL
  LEFT JOIN scaled v ON v.transaction_id = s.transaction_id AND v.feature = n.feature
  LEFT JOIN placed p ON p.transaction_id = s.transaction_id AND p.feature = n.feature)
SELECT s.transaction_id, avg(n.fraud_share) AS p FROM steps s
JOIN nodes n ON n.tree = s.tree AND n.node = s.node AND n."left" IS NULL GROUP BY 1"""


@pytest.fixture(scope="module")
def scored(spark, small, tmp_path_factory):
    from testbed.views import spark_view

    labelled = materialize(add_fraud_labels(materialize(offline_features(spark_view(spark, small, "txns")), "features")), "training")
    trained = ml.train(labelled, Settings(num_trees=12, max_depth=6))
    kept = labelled.select("transaction_id", *NUMERIC_FEATURES, *CATEGORICAL_FEATURES)
    return trained.model, materialize(ml.probability(kept, trained.model), "scored"), tmp_path_factory.mktemp("tables")


def test_duckdb_walks_the_trees_to_the_same_probabilities(spark, scored):
    model, rows, base = scored
    tables = {"rows": rows, "nodes": node_table(spark, model), "categories": model.categories, "scaler": model.scaler}
    for name, table in tables.items():
        table.write.parquet(f"{base}/{name}")
    sql = WALK.format(
        **{name: f"{base}/{name}" for name in tables},
        numbers=", ".join(f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) ELSE 0 END AS {c}" for c in NUMERIC_FEATURES),
        names=", ".join(NUMERIC_FEATURES),
        texts=", ".join(f"coalesce(CAST({c} AS VARCHAR), 'UNKNOWN') AS {c}" for c in CATEGORICAL_FEATURES),
        kinds=", ".join(CATEGORICAL_FEATURES),
    )
    walked = dict(duckdb.sql(sql).fetchall())
    given = {r["transaction_id"]: r["fraud_probability"] for r in rows.collect()}
    assert walked.keys() == given.keys() and len(given) == 1000
    assert max(abs(walked[k] - given[k]) for k in given) < 1e-12
    assert len({round(p, 6) for p in given.values()}) > 50


def test_walk_in_spark_agrees(spark, scored):
    model, rows, _ = scored
    found = rows.join(walk(rows, node_table(spark, model), model), "transaction_id")
    assert found.count() == 1000
    assert found.filter("abs(walked_probability - fraud_probability) > 1e-12").count() == 0


def test_nodes_are_whole_trees(spark, scored):
    nodes = node_table(spark, scored[0])
    assert nodes.schema == NODES
    by = {(r["tree"], r["node"]): r for r in nodes.collect()}
    for (tree, _), r in by.items():
        if r["left"] is not None:
            assert (tree, r["left"]) in by and (tree, r["right"]) in by and r["fraud_share"] is None
        else:
            assert 0 <= r["fraud_share"] <= 1
    assert {t for t, _ in by} == set(range(12))


def test_the_scaler_table_is_what_the_model_uses(spark, scored):
    """Another mean in the table moves the scores."""
    from pyspark.sql import functions as F

    model, rows, _ = scored
    moved = ml.ScoringModel(model.stages, model.categories, model.scaler.withColumn("mean", F.col("mean") + 5 * F.col("std")))
    again = ml.probability(rows.drop("fraud_probability"), moved).select("transaction_id", F.col("fraud_probability").alias("p"))
    assert again.join(rows, "transaction_id").filter("abs(p - fraud_probability) > 0.01").count() > 100


def test_walk_keeps_one_row_per_key_and_takes_odd_values(spark, scored):
    """Unknown categories, missing numbers and repeated ids walk as the model scores them."""
    from pyspark.sql import functions as F

    model, rows, _ = scored
    odd = rows.limit(40).withColumns({"merchant_id": F.lit("nowhere"), "card_provider": F.lit(None).cast("string"), "amount": F.lit(float("nan"))})
    odd = materialize(odd.drop("fraud_probability"), "odd")
    walked = {r[0]: r[1] for r in walk(odd.unionAll(odd), node_table(spark, model), model).collect()}
    given = {r["transaction_id"]: r["fraud_probability"] for r in ml.probability(odd, model).collect()}
    assert len(walked) == 40 and walked.keys() == given.keys()
    assert max(abs(walked[k] - given[k]) for k in given) < 1e-12


def test_a_walked_row_stays_one_row(spark, scored):
    """It was made a hundred rows, each joined with the nodes once a level; nor do the trees go along as its values."""
    model, rows, _ = scored
    text = walk(rows, node_table(spark, model), model)._jdf.queryExecution().executedPlan().toString()
    upper = text.split("Subquery")[0]
    assert "transform(" in upper and "Generate" not in text
    assert not re.search(r"Join|held#", upper)


def test_node_table_reads_the_nodes_at_once(spark, scored, monkeypatch):
    """Not one by one over the bridge to the JVM."""
    from pyspark.ml.classification import DecisionTreeClassificationModel

    asked = []
    call = DecisionTreeClassificationModel._call_java
    monkeypatch.setattr(DecisionTreeClassificationModel, "_call_java", lambda self, *args: asked.append(args) or call(self, *args))
    assert node_table(spark, scored[0]).groupBy("tree").count().count() == 12
    assert asked == []


def test_training_rows_are_dealt_evenly_whatever_the_files(spark, small, monkeypatch):
    """A stored table with one row group is one task to a scan, but not to the forest."""
    from pyspark.ml import Pipeline
    from pyspark.sql import functions as F

    from testbed.views import spark_view
    from txnscore import session

    monkeypatch.setattr(session, "SPREAD_LEAST", 100)
    labelled = add_fraud_labels(materialize(offline_features(spark_view(spark, small, "txns")).coalesce(1), "features"))
    sizes, fit = [], Pipeline.fit

    def seen(self, rows, *args):
        sizes.extend(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())
        return fit(self, rows, *args)

    monkeypatch.setattr(Pipeline, "fit", seen)
    trained = ml.train(materialize(labelled.coalesce(1), "training"), Settings(num_trees=2, max_depth=2))
    assert sum(sizes) == 800 and len(sizes) >= 8 and max(sizes) <= 2 * 800 / len(sizes)
    assert trained.test.count() == 200


def test_rows_of_a_task_are_fitted_in_the_order_of_their_values(spark, small, monkeypatch):
    """Rows next to each other then fall into the same nodes; they came in any order before."""
    from pyspark.ml import Pipeline
    from pyspark.sql import functions as F

    from testbed.views import spark_view

    labelled = materialize(add_fraud_labels(materialize(offline_features(spark_view(spark, small, "txns")), "features")), "training")
    tasks, fit = {}, Pipeline.fit

    def seen(self, rows, *args):
        columns = [*[f"{c}_index" for c in CATEGORICAL_FEATURES], *[f"{c}_scaled" for c in NUMERIC_FEATURES]]
        for r in rows.withColumn("task", F.spark_partition_id()).collect():
            tasks.setdefault(r["task"], []).append(tuple(r[c] for c in columns))
        return fit(self, rows, *args)

    monkeypatch.setattr(Pipeline, "fit", seen)
    ml.train(labelled, Settings(num_trees=2, max_depth=2))
    assert sum(map(len, tasks.values())) == 800
    assert all(rows == sorted(rows) for rows in tasks.values())


def test_versions_score_features_that_are_made_once(spark, small, monkeypatch):
    """Every version worked them out again, as did the count of its rows."""
    from types import SimpleNamespace

    from testbed import queries

    model, made, make = SimpleNamespace(), [], queries._feature_rows
    monkeypatch.setattr(queries, "_feature_rows", lambda v: made.append(make(v)) or made[-1])
    monkeypatch.setattr(queries, "_trained", lambda *_: SimpleNamespace(model=model, metrics=None))
    monkeypatch.setattr(queries.ModelRegistry, "save", lambda *_: None)
    monkeypatch.setattr(queries.ModelRegistry, "load", lambda *_: model)
    versions = spark.createDataFrame([("v1", "a", "b", None), ("v2", "a", "c", "{}")], "version STRING, name STRING, description STRING, metrics STRING")
    monkeypatch.setattr(queries.ModelRegistry, "versions", lambda *_: versions)
    monkeypatch.setattr(queries.ml, "score", lambda rows, _: rows.withColumn("fraud_probability", rows["amount"] * 0))
    found = queries.QUERIES["model_versions"](spark, small)
    assert "events.parquet" not in found._jdf.queryExecution().optimizedPlan().toString() + str(found.inputFiles())
    assert len(made) == 1 and [r["rows_scored"] for r in found.collect()] == [1000, 1000]


def test_a_batch_is_dealt_evenly_before_the_forest(spark, small, monkeypatch):
    """It was scored in the tasks the joins left, in one stage with them."""
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from testbed import queries
    from txnscore import session
    from txnscore.plans.results import flag_predictions
    from txnscore.streaming import score as streaming

    sizes = []

    def scored(rows, model, threshold):
        sizes.extend(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())
        return flag_predictions(rows.withColumn("fraud_probability", F.lit(0.9)), threshold)

    monkeypatch.setattr(session, "SPREAD_LEAST", 100)
    monkeypatch.setattr(streaming, "score", scored)
    monkeypatch.setattr(queries, "_trained", lambda *_: SimpleNamespace(model=None))
    assert queries.QUERIES["score_batch"](spark, small).filter("flag_fits").count() == 1000
    assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) <= 110
