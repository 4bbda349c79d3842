"""A fitted forest as tables, and scoring by walking them.

The node table says what the forest does in plain columns, so that any engine can score
with it and a score can be explained: a node tests one numeric feature against a
threshold, or asks for one category of a categorical feature; a leaf has the votes of
its training rows. ``walk`` is such a scorer in built-in functions; the tests hold
another one, in plain SQL of another engine, against the model.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnscore.functions import features as fx
from txnscore.ml.model import ScoringModel, scaled_numbers
from txnscore.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from txnscore.session import fresh_path

NODES = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("fraud_share", T.DoubleType()),
    ]
)


def forest_of(model: ScoringModel) -> RandomForestClassificationModel:
    return next(s for s in model.stages.stages if isinstance(s, RandomForestClassificationModel))


def node_table(spark: SparkSession, model: ScoringModel) -> DataFrame:
    """One row per node of every tree, numbered from 0 in each; ``left`` is taken where the test holds.

    A numeric node tests ``scaled feature <= threshold``; a categorical one (``place`` is
    set) tests that the category is another than the one of this place in the category
    table. ``fraud_share`` of a leaf is the share of class 1 among its training rows. A
    forest has at most trees * 2**(depth + 1) nodes, a bound of its settings, whatever
    the data. They are read from the forest as it is stored: asked one by one over the
    bridge to the JVM, they would take the driver a millisecond each.
    """
    widths = {r["feature"]: r["n"] for r in model.categories.groupBy("feature").agg(F.max("place").alias("n")).collect()}
    path = fresh_path(spark, "forest")
    forest_of(model).write().save(path)
    n, split = F.col("nodeData"), F.col("nodeData.split")
    slot, inner = split["featureIndex"], n["leftChild"] >= 0
    at = len(NUMERIC_FEATURES)
    feature, place = F.get(F.array(*[F.lit(c) for c in NUMERIC_FEATURES]), slot), F.lit(None)
    for c in CATEGORICAL_FEATURES:
        feature, place = F.when(slot >= at, c).otherwise(feature), F.when(slot >= at, slot - at).otherwise(place)
        at += widths[c] + 1
    # The place's own entry is 0 or 1; the left child here has the rows without it.
    swapped = place.isNotNull() & (split["numCategories"] >= 0) & ~F.array_contains(split["leftCategoriesOrThreshold"], 0.0)
    left, right = n["leftChild"], n["rightChild"]
    stats = n["impurityStats"]
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        n["id"].alias("node"),
        F.when(inner, feature).alias("feature"),
        F.when(inner & place.isNull(), split["leftCategoriesOrThreshold"][0]).alias("threshold"),
        F.when(inner, place).alias("place"),
        F.when(inner, F.when(swapped, right).otherwise(left)).alias("left"),
        F.when(inner, F.when(swapped, left).otherwise(right)).alias("right"),
        F.when(~inner, stats[1] / F.aggregate(stats, F.lit(0.0), lambda total, x: total + x)).alias("fraud_share"),
    )


def walk(rows: DataFrame, nodes: DataFrame, model: ScoringModel, key: str = "transaction_id") -> DataFrame:
    """``key`` and ``walked_probability``: the mean over all trees of the share in the leaf a row falls into.

    A row enters every tree at its root and takes one step per level. A tree is an array of
    its nodes in the order of their numbers, so a step is a look at one place of it: a row
    stays one row and meets no join. All trees are one value, bounded by the forest's
    settings, that every task gets.
    """
    named = model.categories.select("feature", F.col("place").cast("int").alias("place"), "category")
    kinds = ((c, k) for columns in (NUMERIC_FEATURES, CATEGORICAL_FEATURES) for k, c in enumerate(columns))
    test = F.create_map(*[F.lit(x) for kind in kinds for x in kind])[F.col("feature")].alias("test")
    # A leaf leads back to itself.
    left, right = (F.coalesce(c, "node").alias(c) for c in ("left", "right"))
    node = F.struct("node", test, "threshold", "category", left, right, "fraud_share")
    grown = nodes.join(named, ["feature", "place"], "left").groupBy("tree").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    trees = grown.agg(F.collect_list("nodes")).scalar()

    forest = forest_of(model)
    levels = F.sequence(F.lit(1), F.lit(forest.getMaxDepth()))
    values = F.array(*scaled_numbers(model.scaler).values())
    texts = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit(fx.UNKNOWN)) for c in CATEGORICAL_FEATURES])

    def leaf_share(row, tree):
        def step(at, _):
            number_fits = F.get(row["x"], at["test"]) <= at["threshold"]
            holds = F.when(at["category"].isNull(), number_fits).otherwise(F.get(row["t"], at["test"]) != at["category"])
            return F.get(tree, F.when(holds, at["left"]).otherwise(at["right"]))

        return F.aggregate(levels, F.get(tree, F.lit(0)), step, lambda at: at["fraud_share"])

    # As the element of an array, a row's values are worked out once and not for every step.
    # The trees may not be named inside the functions, but Spark puts both projections into one.
    held = rows.select(key, F.array(F.struct(values.alias("x"), texts.alias("t"), trees.alias("trees"))).alias("held"))
    share = F.transform("held", lambda row: F.aggregate(row["trees"], F.lit(0.0), lambda total, tree: total + leaf_share(row, tree)))
    walked = held.select(key, (share[0] / forest.getNumTrees).alias("walked_probability"))
    return walked.groupBy(key).agg(F.avg("walked_probability").alias("walked_probability"))
