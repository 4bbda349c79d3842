"""Live tail of a table of micro-batches: every committed batch once, whatever was tried again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnscore.sources.batches import BatchTable
from txnscore.sources.files import Folder


def of_run(rows: DataFrame, run_id: str | None) -> DataFrame:
    return rows if run_id is None else rows.filter(F.col("run_id") == run_id)


def drain(
    table: BatchTable, view: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, run_id: str | None = None,
    files_per_trigger: int = 8, name: str | None = None,
) -> DataFrame:
    """Append what was committed since the last call to ``out`` and return all of it.

    The checkpoint is the reader's position. A step writes to a folder of its own number,
    which a repeated step overwrites, so a row is in ``out`` once. ``name`` is the view
    whose mark hides earlier batches.
    """

    def keep(rows: DataFrame, number: int) -> None:
        of_run(view(rows), run_id).write.mode("overwrite").parquet(f"{out}/step={number}")

    table.follow(keep, checkpoint, name, files_per_trigger).awaitTermination()
    shape = of_run(view(table.of([])), run_id)
    if not Folder(table.spark, out).names():
        return shape
    return table.spark.read.schema(shape.schema).parquet(out).select(*shape.columns)
