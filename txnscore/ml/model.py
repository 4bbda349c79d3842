"""The scoring model: encode, train, evaluate, score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnscore.config import DEFAULTS, Settings
from txnscore.functions import features as fx
from txnscore.ml.metrics import argmax_class, classification_report, confusion_matrix, eval_metrics
from txnscore.operators.number import numbered
from txnscore.plans.labels import mark_split, split_edges
from txnscore.plans.results import flag_predictions
from txnscore.schemas import CATEGORICAL_FEATURES, MODEL_FEATURES, NUMERIC_FEATURES, require_columns
from txnscore.session import materialize, spread

# Above every place a category table can give.
UNSEEN = 2.0**31 - 2


def _texts() -> dict[str, Column]:
    return {
        f"{c}_text": F.coalesce(F.col(c).cast("string"), F.lit(fx.UNKNOWN)) for c in CATEGORICAL_FEATURES
    }


def _numbers() -> dict[str, Column]:
    """Numbers the assembler accepts: what is missing or not finite is 0."""
    return {f"{c}_num": F.coalesce(fx.finite(F.col(c).cast("double")), F.lit(0.0)) for c in NUMERIC_FEATURES}


def model_input(rows: DataFrame) -> DataFrame:
    """Feature columns in the types the fitted stages read."""
    require_columns(rows, MODEL_FEATURES)
    return rows.withColumns({**_numbers(), **_texts()})


def scaler_fit(rows: DataFrame) -> DataFrame:
    """Mean and population deviation of every numeric feature, one row each: the model's scaler."""
    numbers = {c: _numbers()[f"{c}_num"] for c in NUMERIC_FEATURES}
    folded = rows.agg(
        *[F.avg(x).alias(f"{c}_mean") for c, x in numbers.items()],
        *[F.stddev_pop(x).alias(f"{c}_std") for c, x in numbers.items()],
    )
    return folded.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(f"{c}_mean").alias("mean"),
                        F.col(f"{c}_std").alias("std"),
                    )
                    for c in NUMERIC_FEATURES
                ]
            )
        )
    )


def scaled_numbers(fitted: DataFrame) -> dict[str, Column]:
    """Every numeric feature, centred and divided by its deviation (1 if that is 0).

    The fitted table has one row per numeric feature, eight in all: its values become
    constants of the expressions.
    """
    found = {r["feature"]: (r["mean"] or 0.0, r["std"] or 1.0) for r in fitted.collect()}
    return {c: (_numbers()[f"{c}_num"] - found[c][0]) / found[c][1] for c in NUMERIC_FEATURES}


def scaled(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """``rows`` with their numeric features scaled."""
    return rows.withColumns(scaled_numbers(fitted))


def encoder_fit(rows: DataFrame) -> DataFrame:
    """Distinct categories of every categorical feature with their counts."""
    votes = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(fx.UNKNOWN)).alias("category"))
            for c in CATEGORICAL_FEATURES
        ]
    )
    return (
        rows.select(F.explode(votes).alias("v"))
        .groupBy("v.feature", "v.category")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def category_table(rows: DataFrame) -> DataFrame:
    """``feature``, ``category`` and its ``place``: the most frequent first, then by name."""
    order = (F.col("rows").desc(), F.col("category"))
    return numbered(encoder_fit(rows), ["feature"], order, "place").select("feature", "category", "place")


def with_places(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """``model_input`` rows with ``<feature>_index``, joined by value from the category table.

    A category the table doesn't have gets ``UNSEEN``, which encodes as all zeros. No
    list of categories is held anywhere, so a column may have any number of them.
    """
    for c in CATEGORICAL_FEATURES:
        own = categories.filter(F.col("feature") == c).select(F.col("category").alias(f"{c}_text"), F.col("place").alias(f"{c}_index"))
        rows = rows.join(own, f"{c}_text", "left")
    return rows.withColumns({f"{c}_index": F.coalesce(F.col(f"{c}_index").cast("double"), F.lit(UNSEEN)) for c in CATEGORICAL_FEATURES})


def encoding_stages() -> list:
    """The stages behind ``with_places`` and the scaler."""
    indexed = [f"{c}_index" for c in CATEGORICAL_FEATURES]
    hot = [f"{c}_hot" for c in CATEGORICAL_FEATURES]
    return [
        # A place beyond those of the training rows is one more category, which is dropped.
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True, handleInvalid="keep"),
        VectorAssembler(inputCols=[*[f"{c}_scaled" for c in NUMERIC_FEATURES], *hot], outputCol="features"),
    ]


def encoded_input(rows: DataFrame, categories: DataFrame, scaler: DataFrame) -> DataFrame:
    """What ``encoding_stages`` read: places of the categories and scaled numbers."""
    numbers = {f"{c}_scaled": x for c, x in scaled_numbers(scaler).items()}
    return with_places(model_input(rows), categories).withColumns(numbers)


@dataclass(frozen=True)
class ScoringModel:
    """Fitted stages, and the category and scaler tables they were fitted with."""

    stages: PipelineModel
    categories: DataFrame
    scaler: DataFrame

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.stages.transform(encoded_input(rows, self.categories, self.scaler))

    def save(self, path: str) -> None:
        self.categories.write.parquet(f"{path}/categories")
        self.scaler.coalesce(1).write.parquet(f"{path}/scaler")
        self.stages.write().save(f"{path}/stages")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ScoringModel":
        read = spark.read.parquet
        return cls(PipelineModel.load(f"{path}/stages"), read(f"{path}/categories"), read(f"{path}/scaler"))


@dataclass(frozen=True)
class Trained:
    model: ScoringModel
    metrics: DataFrame
    test: DataFrame
    report: DataFrame
    confusion: DataFrame


def train(labelled: DataFrame, settings: Settings = DEFAULTS) -> Trained:
    """Fit on the training share only and evaluate on the rest.

    ``labelled`` should be a stored table: fitting scans its feature columns
    several times. The split itself is kept as one edge per class, so it costs
    a hash per row and no copy of the rows.
    """
    require_columns(labelled, [*MODEL_FEATURES, "is_fraud", "transaction_id"])
    kept = labelled.select(*MODEL_FEATURES, "is_fraud", "transaction_id")
    key = ("is_fraud", "transaction_id")
    edges = materialize(split_edges(kept, *key, settings.test_size, settings.random_state), "edges")
    rows = mark_split(kept, edges, *key, settings.random_state)
    learnt = rows.filter("is_test = 0")
    categories = materialize(category_table(learnt), "categories")
    scaler = materialize(scaler_fit(learnt), "scaler")
    size = kept.count()
    read = ["is_fraud", *[f"{c}_index" for c in CATEGORICAL_FEATURES], *[f"{c}_scaled" for c in NUMERIC_FEATURES]]
    # Stored, as the stages and the forest's summary each take these rows from their source again.
    encoded = materialize(encoded_input(learnt, categories, scaler).select(*read), "encoded")
    fit_rows = alike(spread(encoded, size), read[1:])
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol="is_fraud",
        numTrees=settings.num_trees,
        maxDepth=settings.max_depth,
        seed=settings.random_state,
        # Rows keep their place in every tree instead of walking it again for each level;
        # written checkpoints of the places would cost more than working them out again.
        cacheNodeIds=True,
        checkpointInterval=-1,
    )
    # The copy leaves out the forest's training summary, which holds on to the
    # session and would be serialized with every scoring task.
    model = ScoringModel(Pipeline(stages=[*encoding_stages(), forest]).fit(fit_rows).copy(), categories, scaler)
    test = materialize(
        probability(spread(rows.filter("is_test = 1"), size), model).select("transaction_id", "is_fraud", "fraud_probability"),
        "evaluation",
    )
    likelier = argmax_class(F.col("fraud_probability"))
    metrics = eval_metrics(test, "is_fraud", "fraud_probability", settings.fraud_threshold)
    return Trained(
        model,
        # Stored, so that printing and registering them doesn't compute them again.
        materialize(metrics, "metrics"),
        test,
        materialize(classification_report(test, "is_fraud", likelier), "report"),
        materialize(confusion_matrix(test, "is_fraud", likelier), "confusion"),
    )


def alike(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with those of like values next to each other in every task.

    They fall into the same nodes of most trees, so a level of the forest finds the counts
    it adds to still at hand; in any other order each row looks them up in the counts of all
    nodes, hundreds of MB a task.
    """
    return rows.sortWithinPartitions(*columns)


def probability(rows: DataFrame, model: ScoringModel) -> DataFrame:
    """``rows`` with ``fraud_probability``, the probability of class 1."""
    scored = model.transform(rows)
    return scored.select(
        *[F.col(c) for c in rows.columns],
        vector_to_array("probability")[1].alias("fraud_probability"),
    )


def score(features: DataFrame, model: ScoringModel, threshold: float = DEFAULTS.fraud_threshold) -> DataFrame:
    """Predictions: probability and flag on top of the input columns."""
    return flag_predictions(probability(features, model), threshold)
