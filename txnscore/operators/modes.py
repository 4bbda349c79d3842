"""Most frequent value with a stated tie rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preference(value: Column | str, count: Column | str, first_seen: Column | str, where: Column) -> Column:
    """Aggregate: the value with the highest count; ties go to the value seen
    first (one without a time comes last), then to the smaller value. Rows failing
    ``where`` or without a value do not take part."""
    value, count, first_seen = (F.col(c) if isinstance(c, str) else c for c in (value, count, first_seen))
    order = F.struct(-count, first_seen.isNull(), first_seen, value)
    return F.min_by(value, F.when(where & value.isNotNull(), order))


def most_frequent(rows: DataFrame, key: str, value: str, seen: str) -> DataFrame:
    """``key`` and its most frequent ``value``; two partially aggregated steps."""
    counted = rows.groupBy(key, value).agg(
        F.count(F.lit(1)).alias("uses"), F.min(seen).alias("first_use")
    )
    return counted.groupBy(key).agg(
        preference(value, "uses", "first_use", F.lit(True)).alias(value)
    )
