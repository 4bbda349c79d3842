"""Contiguous shards of nearly equal bytes, by prefix sums over the whole table.

Rows stand in the order of their ids. They are dealt by ranges of that order into
partitions; the bytes of each partition are totalled, the running sum of these
totals tells where every partition begins, and a running sum inside the partition
tells where every row does. A row goes to the shard in which its middle byte lies,
so cuts fall as near to equal targets as whole rows allow.

Everything is DataFrame functions. Only ids and sizes are shuffled, ties of an id are
spread by arrival, and no task sees more than one partition's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnscore.session import materialize

SHARDS = 16
_ORDER = ("doc_id", "arrival")


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _sized(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(_text(text_col)) + 1).cast("long").alias("size"),
        F.crc32(_text(text_col).cast("binary")).alias("text_crc32"),
    ]


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (doc_id, arrival, size and others) with ``shard`` and their ``place`` among all rows, stored."""
    dealt = rows.repartitionByRange(*_ORDER).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "shard-parts")
    # One row per partition: as many as the shuffle has partitions, whatever the table's size.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    begins = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
    )
    inside = Window.partitionBy("part").orderBy(*_ORDER)
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Dealt by ranges of its number, every partition is a task of its own again.
    local = dealt.repartitionByRange("part").withColumns({"begin": before, "place": F.row_number().over(inside) - 1})
    total = dealt.agg(F.sum("size")).scalar()
    joined = local.join(begins, "part").withColumns({"begin": F.col("begin") + F.col("bytes_before"), "total": total})
    # The middle of a row, counted in halves of a byte so that all is integers.
    shard = F.expr(f"((2 * begin + size) * {shards}L) div (2 * total)")
    return materialize(
        joined.withColumns({"shard": F.least(shard, F.lit(shards - 1)).cast("int"), "place": (F.col("place") + F.col("rows_before")).cast("long")}).drop(
            "part", "begin", "total", "bytes_before", "rows_before"
        ),
        "shard-places",
    )


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row.

    ``size`` is the UTF-8 bytes of the text plus 1 (NULL and empty texts: 1), so every row
    weighs something; ``slot`` numbers a shard's rows from 0 in the order of ids. NULL ids
    come first, rows of one id in the order read. A row that is larger than a shard's
    share takes the shard of its middle and may leave a neighbour empty. An empty table
    has no rows; columns of ``docs`` beyond the two named are never read.
    """
    rows = materialize(docs.select(*_sized(docs, id_col, text_col), F.monotonically_increasing_id().alias("arrival")), "shard-sizes")
    placed = _placed(rows, shards)
    # One row per shard.
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write(docs: DataFrame, folder: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all their columns in folders ``shard=<number>`` below ``folder``, the written table.

    The placement is that of ``assign``. It reaches the rows as one cut per shard, so
    the texts are shuffled once, by shard, when they are written. A column ``shard`` of
    ``docs`` itself is refused.
    """
    if "shard" in docs.columns:
        raise ValueError("the column shard names the folders")
    names = docs.columns
    staged = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), *_sized(docs, id_col, text_col), F.monotonically_increasing_id().alias("arrival"))
    staged = materialize(staged, "shard-rows")
    placed = _placed(staged.select("doc_id", "size", "arrival"), shards)
    firsts = placed.groupBy("shard").agg(F.min(F.struct(*_ORDER)).alias("begin"))
    cuts = firsts.agg(F.array_sort(F.collect_list(F.struct("begin", "shard")))).scalar()
    own = F.filter(F.col("cuts"), lambda c: c["begin"] <= F.struct(*_ORDER))
    rows = staged.withColumn("cuts", cuts).withColumn("shard", F.element_at(own, -1)["shard"])
    rows = rows.repartitionByRange("shard", *_ORDER).sortWithinPartitions("shard", *_ORDER)
    rows.select("row.*", "shard").write.mode("overwrite").partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.parquet(folder)
