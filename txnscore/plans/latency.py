"""Latency summaries: exact percentiles per group, and merging of summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnscore.functions.features import finite, half_up
from txnscore.operators.ranks import values_at_ranks

# Reported percentiles, and the size below which a group takes
# the sample at int(n * q) instead of interpolating.
PERCENTILES = (("p50_ms", 0.50), ("p95_ms", 0.95), ("p99_ms", 0.99))
SMALL_SAMPLE = 10
LATENCY_FIELDS = ("avg_ms", "p50_ms", "p95_ms", "p99_ms", "min_ms", "max_ms")
# Bins of 0.01 ms: a clock that counts nanoseconds has 10,000 values per bin. They lie
# in bins of 41 ms, of which a minute has 1,500, so no window holds more than that.
_BINS_PER_MS = 100
_BINS_PER_BIN = 4096


def _position(n: Column, q: float) -> Column:
    return F.when(n >= SMALL_SAMPLE, (n - 1) * F.lit(q)).otherwise(F.floor(n * F.lit(q)).cast("double"))


def _wanted_ranks(n: Column) -> list[Column]:
    spots = []
    for _, q in PERCENTILES:
        at = _position(n, q)
        spots += [F.floor(at), F.ceil(at)]
    return spots


def percentiles(
    rows: DataFrame, keys: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """Exact p50, p95 and p99 of each group, linearly interpolated.

    Values are counted per distinct value first (partial aggregation), then the
    wanted ranks are located by bins; a hot group is never sorted as a whole.
    """
    times = F.sum(weight) if weight else F.count(F.lit(1))
    counted = (
        rows.filter(finite(F.col(value)).isNotNull())
        .groupBy(*keys, value)
        .agg(times.alias("times"))
        .withColumn("bin", F.floor(F.col(value) * _BINS_PER_MS))
        .withColumn("coarse", F.floor(F.col("bin") / _BINS_PER_BIN))
    )
    found = values_at_ranks(counted, keys, ["coarse", "bin"], value, _wanted_ranks, weight="times")
    wide = found.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("slot") == i, F.col("value"))).alias(f"v{i}") for i in range(2 * len(PERCENTILES))],
    )
    columns = []
    for i, (name, q) in enumerate(PERCENTILES):
        at = _position(F.col("n"), q)
        low, high = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        columns.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return wide.select(*keys, *columns)


def mean_ms(total: Column, count: Column) -> Column:
    return total.cast("double") / count


def latency_sums(value: str) -> list[Column]:
    """Partial aggregates of a latency column; the sum is exact to a nanosecond."""
    latency = finite(F.col(value))
    return [
        F.sum(latency.try_cast("decimal(24,6)")).alias("total_ms"),
        F.min(latency).alias("min_ms"),
        F.max(latency).alias("max_ms"),
        F.count(latency).alias("latency_count"),
    ]


def rounded(digits: int = 2, names: Sequence[str] = LATENCY_FIELDS) -> dict[str, Column]:
    return {n: F.coalesce(half_up(F.col(n), digits), F.lit(0.0)) for n in names}


def latency_stats(rows: DataFrame, keys: Sequence[str], value: str, digits: int = 2) -> DataFrame:
    """avg, p50, p95, p99, min, max and count of ``value`` per group."""
    summed = rows.groupBy(*keys).agg(*latency_sums(value)).filter(F.col("latency_count") > 0)
    joined = summed.join(percentiles(rows, keys, value), list(keys))
    return (
        joined.withColumn("avg_ms", mean_ms(F.col("total_ms"), F.col("latency_count")))
        .withColumns(rounded(digits))
        .select(*keys, *LATENCY_FIELDS, F.col("latency_count").alias("count"))
    )


def merge_latency(
    summaries: DataFrame, keys: Sequence[str], count: str = "count", digits: int = 2
) -> DataFrame:
    """Summaries of the same key merged: weighted average, highest percentiles,
    lowest minimum; summaries without measurements are ignored."""
    merged = summaries.groupBy(*keys).agg(*merged_latency(count))
    return merged.withColumns(rounded(digits))


def merged_latency(count: str) -> list[Column]:
    n = F.col(count)
    some = n > 0
    weighted = F.sum(F.when(some, F.col("avg_ms").cast("decimal(18,6)") * n.cast("decimal(19,0)")))
    total = F.sum(F.when(some, n))
    top = lambda name: F.max(F.when(some, F.col(name))).alias(name)
    return [
        (weighted.cast("double") / total).alias("avg_ms"),
        top("p50_ms"),
        top("p95_ms"),
        top("p99_ms"),
        F.min(F.when(some, F.col("min_ms"))).alias("min_ms"),
        top("max_ms"),
        F.coalesce(total, F.lit(0)).alias(count),
    ]
