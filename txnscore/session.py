"""Session defaults and reliable materialisation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from txnscore.sources.files import Folder

RUNTIME_CONF = {
    # Epoch, date and timestamp arithmetic is defined in UTC throughout.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Rows of a task of ``spread``: fewer aren't worth a task, more don't stay in its memory.
SPREAD_LEAST, SPREAD_MOST = 2_000, 250_000


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job here relies on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary
    folder; on a cluster a machine-local folder would be lost with its host.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="txnscore-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new, unused path below the scratch folder."""
    return f"{scratch_dir(spark)}/txnscore/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to shared storage and continue from the written table.

    Used where several passes follow an expensive plan: the copy is columnar,
    survives lost executors and cuts the lineage.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def kept_while(df: DataFrame, tag: str) -> Iterator[DataFrame]:
    """``materialize`` for the length of a block, after which the copy is removed: for work that never ends, as a stream's."""
    path = fresh_path(df.sparkSession, tag)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        Folder(df.sparkSession, path).remove("")


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt evenly over tasks: two for every core, or more if these get large.

    A stored table is read in as many tasks as it has row groups, one for a million narrow
    rows. That suits a scan; this is for work that costs far more than its bytes say, like
    fitting and walking a forest.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(2 * cores, rows // SPREAD_LEAST), rows // SPREAD_MOST))
