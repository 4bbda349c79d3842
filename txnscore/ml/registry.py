"""Versioned models: saved pipelines plus an append-only registry table."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnscore.config import DEFAULTS
from txnscore.ml.model import ScoringModel
from txnscore.sources.sinks import table_exists

REGISTRY_SCHEMA = (
    "name STRING, version STRING, description STRING, created_at TIMESTAMP, path STRING, metrics STRING"
)


class ModelRegistry:
    """Models below ``root``: ``models/<name>/<version>`` and the ``model_registry`` table."""

    def __init__(self, spark: SparkSession, root: str, name: str = DEFAULTS.model_name):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self._table = f"{self.root}/model_registry"

    def save(self, model: ScoringModel, description: str = "", metrics: DataFrame | None = None) -> str:
        """Save a new version and return its id; errors are raised, never hidden."""
        now = datetime.now(timezone.utc)
        version = f"{now:%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:6]}"
        path = f"{self.root}/models/{self.name}/{version}"
        model.save(path)
        figures = metrics.select(F.to_json(F.struct("*"))).first()[0] if metrics is not None else None
        row = (self.name, version, description, now.replace(tzinfo=None), path, figures)
        schema = REGISTRY_SCHEMA.replace("created_at TIMESTAMP", "created_at TIMESTAMP_NTZ")
        self.spark.createDataFrame([row], schema).withColumn(
            "created_at", F.col("created_at").cast("timestamp")
        ).write.mode("append").parquet(self._table)
        return version

    def versions(self) -> DataFrame:
        """All versions of this model, newest first."""
        if not table_exists(self.spark, self._table):
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)
        rows = self.spark.read.schema(REGISTRY_SCHEMA).parquet(self._table)
        return rows.filter(F.col("name") == self.name).orderBy(F.col("created_at").desc(), F.col("version").desc())

    def load(self, version: str | None = None) -> ScoringModel:
        """One version, by default the newest; raises ``LookupError`` if there is none."""
        rows = self.versions()
        if version is not None:
            rows = rows.filter(F.col("version") == version)
        found = rows.select("path").first()
        if found is None:
            raise LookupError(f"no version {version or '(latest)'} of model {self.name}")
        return ScoringModel.load(self.spark, found["path"])
