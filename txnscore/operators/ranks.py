"""Exact order statistics by histogram refinement.

A global or per-group sort would put a hot group into one task. Instead the
values are counted per coarse bin (partial aggregation keeps the shuffle small),
the bin that holds each wanted rank is found from the running counts, and only
the rows of those bins go on to the next, finer level.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def values_at_ranks(
    rows: DataFrame,
    keys: Sequence[str],
    bins: Sequence[str],
    value: str,
    ranks: Callable[[Column], Sequence[Column]],
    weight: str | None = None,
    few_keys: bool = False,
) -> DataFrame:
    """The values at given 0-based ascending ranks of each key.

    ``bins`` are columns from coarse to fine; sorting by them and then by
    ``value`` must equal sorting by ``value``. ``ranks`` maps the row count of
    a key to the wanted ranks; ``weight`` counts a row several times. Returns
    one row per key and rank: ``keys, slot, value, n``. ``few_keys`` states
    that the number of keys has a small fixed bound (a class label, or none),
    which bounds the rank targets too, so these are broadcast; otherwise Spark
    decides by size.
    """
    count = F.sum(weight) if weight else F.count(F.lit(1))
    prefix = list(keys)
    slots: list[str] = []
    targets: DataFrame | None = None
    for level in [*bins, value]:
        freq = count.cast("bigint").alias("freq")
        if targets is None:
            counted = rows.groupBy(*prefix, level).agg(freq)
        elif few_keys:
            # The few targets travel with their rows; all rows of a prefix share one.
            carried = [F.first(c).alias(c) for c in ("n", *slots)]
            near = rows.join(F.broadcast(targets), prefix)
            counted = near.groupBy(*prefix, level).agg(freq, *carried)
        else:
            # Many targets: cut the rows first (below any aggregate that made
            # them), then pair each remaining bin with the one target of its prefix.
            near = rows.join(targets.select(*prefix), prefix, "left_semi")
            counted = near.groupBy(*prefix, level).agg(freq).join(targets, prefix)
        ordered = Window.partitionBy(*prefix).orderBy(level)
        before = F.coalesce(
            F.sum("freq").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
        counted = counted.withColumn("before", before)
        if targets is None:
            counted = counted.withColumn("n", F.sum("freq").over(Window.partitionBy(*prefix)))
            wanted = list(ranks(F.col("n")))
            slots = [f"slot{i}" for i in range(len(wanted))]
            counted = counted.withColumns(
                {slot: rank.cast("bigint") for slot, rank in zip(slots, wanted)}
            )
        prefix = [*prefix, level]
        targets = counted.select(
            *prefix,
            "n",
            # The rank inside this bin, NULL for a slot that lies in another one.
            *[
                F.when(
                    F.col(s).between(F.col("before"), F.col("before") + F.col("freq") - 1),
                    F.col(s) - F.col("before"),
                ).alias(s)
                for s in slots
            ],
        ).filter(F.coalesce(*slots).isNotNull())
    found = F.array(*[F.when(F.col(s).isNotNull(), F.lit(i)) for i, s in enumerate(slots)])
    return targets.select(*keys, F.explode(found).alias("slot"), F.col(value).alias("value"), "n").filter(
        F.col("slot").isNotNull()
    )
