"""Keyed tables kept as change logs: last write wins, by row or by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(rows: DataFrame, key: str | Sequence[str], seq: str | Sequence[str]) -> DataFrame:
    """The row with the highest ``seq`` of each key; rows without one come last.

    A limit per key rather than an aggregate of whole rows: each map task cuts a key to
    its last row before anything moves, however many versions a hot key has, and what is
    left is shuffled once.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [seq] if isinstance(seq, str) else list(seq)
    if not [c for c in rows.columns if c not in keys]:
        return rows.distinct()
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("version_rank", F.row_number().over(newest)).filter("version_rank = 1").drop("version_rank")


def merge_fields(
    changes: DataFrame, key: str, seq: str, fields: Sequence[str] | None = None
) -> DataFrame:
    """The last non-NULL value of every field of each key (partial updates)."""
    names = list(fields) if fields else [c for c in changes.columns if c not in (key, seq)]
    picks = [
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in names
    ]
    return changes.groupBy(key).agg(*picks)
