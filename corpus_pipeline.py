"""The corpus pipeline: documents pass a quality classifier, near-duplicate removal,
benchmark decontamination and redaction of secrets; the rest is mixed by source.

Every stage is one operator of ``txnscore.llm`` on all its predecessor kept. A stage
is written as Parquet below the shared scratch folder and reread by the next.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnscore.llm import decontam, jaccard, mix, quality, secrets
from txnscore.llm.shared import ship
from txnscore.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(run: Stage) -> Stage:
    """A stage whose workers have the package."""

    @functools.wraps(run)
    def shipped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, docs, sf_dir)

    return shipped


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, by a network fitted on the labelled ones among them.

    NULL and empty texts are one padded chunk and judged like others; rows that agree in
    their text are judged alike. Without a usable label every score is one half, and all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, that of the smallest id (NULL ids last).

    Documents without words (NULL, empty, blank) are in no group and all stay; of rows that
    agree in id and text one stays.
    """
    return jaccard.keep_one(docs)


@stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that carry no benchmark item; NULL and empty texts stay, an empty benchmark takes none."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked, with the length that leaves.

    A NULL text stays NULL; ``n_chars`` follows where it is a number, NULL stays NULL.
    """
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document that is left.

    NULL and empty texts have no words: none are taken. A NULL source is a source of its
    own. Rows of one source, size and id are alike, so which of them is taken doesn't matter.
    """
    return mix.plan(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("mix", mixed),
]

# No stage but the counting in the last can be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = materialize(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
