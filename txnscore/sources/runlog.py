"""Run metadata as an append-only change log; readers merge it by run and field. Worker snapshots likewise."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnscore.operators.latest import latest_by_key
from txnscore.plans.runstats import RUN_DEFAULTS, WORKER, runs_table
from txnscore.schemas import RUN_CHANGE, WORKER_SNAPSHOT
from txnscore.sources.versions import VersionedLog


class RunLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.log = VersionedLog(spark, path, RUN_CHANGE)

    def start(
        self,
        run_id: str,
        pattern: str = RUN_DEFAULTS["pattern"],
        target_tps: float = RUN_DEFAULTS["target_tps"],
        fraud_ratio: float = RUN_DEFAULTS["fraud_ratio"],
        thread_count: int = RUN_DEFAULTS["thread_count"],
    ) -> None:
        self.update(
            run_id,
            start_time=datetime.now(timezone.utc),
            pattern=pattern,
            target_tps=float(target_tps),
            fraud_ratio=float(fraud_ratio),
            thread_count=int(thread_count),
            complete=False,
        )

    def complete(self, run_id: str, **counters) -> None:
        """End the run; counters such as ``transactions`` may be set along with it."""
        self.update(run_id, end_time=datetime.now(timezone.utc), complete=True, **counters)

    def update(self, run_id: str, **fields) -> None:
        """Set only the given fields of the run."""
        unknown = set(fields) - set(RUN_CHANGE.fieldNames())
        if unknown:
            raise ValueError(f"unknown run fields: {sorted(unknown)}")
        change = {"run_id": run_id, "seq": time.time_ns() // 1000, **fields}
        row = tuple(change.get(name) for name in RUN_CHANGE.fieldNames())
        self.log.append(self.spark.createDataFrame([row], RUN_CHANGE).coalesce(1))

    def changes(self) -> DataFrame:
        return self.log.rows()

    def runs(self) -> DataFrame:
        return runs_table(self.changes())


class WorkerLog:
    """Snapshots of worker statistics; the newest of a run and worker counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.log = VersionedLog(spark, path, WORKER_SNAPSHOT)

    def save(self, workers: DataFrame) -> None:
        self.log.append(workers.withColumn("saved_at", F.current_timestamp()).select(*WORKER_SNAPSHOT.names))

    def workers(self) -> DataFrame:
        return latest_by_key(self.log.rows(), list(WORKER), "saved_at")
