"""Running totals that never put a whole hot key into one task.

A window over one key sorts that key's rows in a single task. Here the order
column is cut into nested buckets: a window runs inside each (key, bucket), the
bucket totals get a window of their own, and the two are combined. No task sees
more than one bucket's rows, or one key's bucket totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}

Measures = Mapping[str, tuple[str, str]]


def _combine(fn: str, left: Column, right: Column) -> Column:
    if fn == "sum":
        return F.coalesce(left + right, left, right)
    return (F.least if fn == "min" else F.greatest)(left, right)


def cumulate(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    before: Measures,
    onward: Measures | None = None,
    levels: Sequence[str] = (),
    distinct_order: bool = False,
) -> DataFrame:
    """Fold measures over the other rows of the same key, along ``order``.

    ``before`` folds the rows with a strictly smaller ``order``, ``onward``
    those with an equal or greater one; both map an output name to
    ``(sum|min|max, input column)``. ``levels`` names bucket columns from fine
    to coarse, each a monotone function of ``order``. ``order`` must be
    integral, unless ``distinct_order`` states that it is unique per key. With
    levels, rows whose key or bucket is NULL are dropped: they have no place in
    the order. (Saying so up front also keeps the two branches below alike, so
    that Spark computes their common input once.)
    """
    for column in [*keys, *levels] if levels else []:
        rows = rows.filter(F.col(column).isNotNull())
    return _fold(rows, keys, order, before, onward or {}, levels, distinct_order, strict_onward=False)


def _fold(rows, keys, order, before, onward, levels, distinct_order, strict_onward) -> DataFrame:
    part = [*keys, *levels]
    measures = {**before, **onward}
    scan = Window.partitionBy(*part)
    # A growing frame is updated row by row; a shrinking one would be refolded
    # for every row, so the onward side runs over the reversed order instead.
    up, down = scan.orderBy(F.col(order).asc()), scan.orderBy(F.col(order).desc())
    frame = "rowsBetween" if distinct_order else "rangeBetween"
    earlier = getattr(up, frame)(Window.unboundedPreceding, -1)
    later = getattr(down, frame)(Window.unboundedPreceding, -1 if strict_onward else 0)
    local = rows.withColumns(
        {
            **{out: _FOLD[fn](source).over(earlier) for out, (fn, source) in before.items()},
            **{out: _FOLD[fn](source).over(later) for out, (fn, source) in onward.items()},
        }
    )
    if not levels:
        return local

    totals = rows.groupBy(*part).agg(
        *[_FOLD[fn](source).alias(f"total_{out}") for out, (fn, source) in measures.items()]
    )
    carried = _fold(
        totals,
        keys,
        levels[0],
        {f"carry_{out}": (fn, f"total_{out}") for out, (fn, _) in before.items()},
        {f"carry_{out}": (fn, f"total_{out}") for out, (fn, _) in onward.items()},
        levels[1:],
        distinct_order=True,
        strict_onward=True,
    ).select(*part, *[f"carry_{out}" for out in measures])
    return (
        local.join(carried, part, "left")
        .withColumns(
            {
                out: _combine(fn, F.col(out), F.col(f"carry_{out}"))
                for out, (fn, _) in measures.items()
            }
        )
        .drop(*[f"carry_{out}" for out in measures])
    )
