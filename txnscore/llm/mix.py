"""Mixing sources to target weights, to the word.

A source's target is met in three steps that only ever look at how many documents
there are of each exact size:

1. whole passes over the source, as often as its total fits into the target;
2. of what remains, the same share of the documents of every size;
3. the rest by bounded-knapsack dynamic programming over the sizes still in stock.

The result says how many documents of each size get one more pass; which ones is
settled by a seeded hash of the id. Counts per size are aggregated before they
move, and of a size's documents only those in one hash bucket are ever ranked, so a
source or a size with a third of all rows is no hot spot.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnscore.llm.shared import WORD_PATTERN
from txnscore.session import materialize

BUCKETS = 4096
# Words that the dynamic programme settles at most, and documents of a size it may give back.
ROOM, GIVE_BACK = 1 << 20, 4


@dataclass(frozen=True)
class Mix:
    """Weights are dealt to the sources in code-point order, NULL last, again and again; a target is at most ``cap`` times its source."""

    weights: tuple[int, ...] = (1, 2, 3)
    cap: int = 3
    seed: int = 11


def targets(sizes: list[int], mix: Mix) -> list[Fraction]:
    """The words each source should give; their sum is that of all sizes unless the caps forbid it."""
    weights = [mix.weights[k % len(mix.weights)] for k in range(len(sizes))]
    out, open_, budget = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(sum(sizes))
    while open_:
        unit = budget / sum(weights[k] for k in open_)
        full = {k for k in open_ if unit * weights[k] > mix.cap * sizes[k]}
        for k in full or open_:
            out[k] = Fraction(mix.cap * sizes[k]) if full else unit * weights[k]
        if not full:
            break
        budget -= sum(out[k] for k in full)
        open_ -= full
    return out


def fill(sizes: np.ndarray, counts: np.ndarray, budget: int, room: int = ROOM) -> np.ndarray:
    """How many documents of each size to take so that the words come as near to ``budget`` as stock allows, not above.

    ``room`` bounds the words that the dynamic programme settles, and so its memory, whatever
    the sizes. Where all that is wanted fits into it the result is the nearest sum there is;
    else the equal shares stay but for some documents of every size, given back to be fitted.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int(sum(s * c for s, c in zip(sizes.tolist(), counts.tolist())))
    if budget >= total:
        return counts.copy()
    taken = np.array([c * budget // total for c in counts.tolist()], np.int64)
    taken[sizes == 0] = 0
    left = budget - int(sum(s * t for s, t in zip(sizes.tolist(), taken.tolist())))
    descending = [k for k in np.argsort(-sizes, kind="stable").tolist() if sizes[k]]
    # One more of a size each, largest first, then as many as there are, until the rest has room.
    for most in (1, None):
        for k in descending:
            if left <= room:
                break
            more = min(int(counts[k] - taken[k]), left // int(sizes[k]), most or -(-(left - room) // int(sizes[k])))
            taken[k] += more
            left -= more * int(sizes[k])
    # Shares are given back, all of them or a few of every size, the smallest first.
    for back in (budget, GIVE_BACK):
        given = np.minimum(taken, back)
        while back < budget and given.any() and left + int(sizes @ given) > room:
            given[int(np.flatnonzero(given)[np.argmax(sizes[np.flatnonzero(given)])])] = 0
        if left + sum(s * g for s, g in zip(sizes.tolist(), given.tolist())) <= room:
            taken = taken - given
            left = budget - int(sum(s * t for s, t in zip(sizes.tolist(), taken.tolist())))
            break
    if not ((sizes > 0) & (sizes <= left) & (taken < counts)).any():
        return taken
    # Reachable sums up to what is left; ``by`` has the item that reached a sum first.
    reach, by, items = np.zeros(left + 1, bool), np.full(left + 1, -1, np.int32), []
    reach[0] = True
    for k in np.flatnonzero((sizes > 0) & (sizes <= left) & (taken < counts)).tolist():
        stock = min(int(counts[k] - taken[k]), left // int(sizes[k]))
        some = 1
        while stock > 0 and not reach[left]:
            some = min(some, stock)
            weight = some * int(sizes[k])
            fresh = np.flatnonzero(reach[: left + 1 - weight] & ~reach[weight:]) + weight
            reach[fresh], by[fresh] = True, len(items)
            items.append((k, some, weight))
            stock -= some
            some *= 2
    at = int(np.flatnonzero(reach)[-1])
    while at:
        k, some, weight = items[by[at]]
        taken[k] += some
        at -= weight
    return taken


def _source_key(source: str = "source"):
    """Equal for equal sources, NULL included."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))


def plan(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``passes`` and ``taken`` for every row.

    ``size`` is the number of words (NULL and empty texts: 0), ``taken`` is ``size`` times the
    passes. Rows of one source, size and id are alike, so which of them gets the last pass
    doesn't matter. Sources are as many as the mix has weights to give: their names and
    totals, one row each, are the only rows the driver sees. An empty table gives no rows.
    """
    spark = docs.sparkSession
    # Every word becomes one letter and every blank nothing: no list of the words is built.
    letters = F.translate(F.regexp_replace(F.col(text_col).cast("string"), WORD_PATTERN, "w"), " \t\n\x0b\x0c\r", "")
    size = F.coalesce(F.char_length(letters), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    draw = F.xxhash64(F.lit(mix.seed), F.col("doc_id"))
    rows = rows.withColumns({"key": _source_key(), "draw": draw}).withColumn("bucket", F.pmod(F.shiftright("draw", 40), F.lit(BUCKETS)).cast("int"))
    rows = materialize(rows, "mix-sizes")
    parts = rows.groupBy("key", "size", "bucket").agg(F.count("*").alias("n"))
    stock = rows.groupBy("key", "size").agg(F.count("*").alias("n"))
    totals = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("total")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["total"] for r in totals], mix)
    settled = {}
    for r, t in zip(totals, wanted):
        passes = min(mix.cap, int(t // r["total"])) if r["total"] else 0
        settled[r["key"]] = (r["total"], float(t), passes, int(t - passes * r["total"]))
    given = spark.createDataFrame([(k, *v) for k, v in settled.items()], "key string, source_size long, target double, whole int, rest long")

    def one_source(key, frame):
        frame = frame.sort_values("size")
        frame["more"] = fill(frame["size"].to_numpy(), frame["n"].to_numpy(), int(frame["rest"].iloc[0]))
        return frame[["key", "size", "more"]]

    # A source's sizes, not its documents, meet in one task.
    more = stock.join(F.broadcast(given.select("key", "rest")), "key").groupBy("key").applyInPandas(one_source, "key string, size long, more long")
    more = materialize(more, "mix-picks")
    # The bucket in which the last pick of a size falls, and how many are picked in it.
    upto = Window.partitionBy("key", "size").orderBy("bucket")
    run = parts.withColumn("upto", F.sum("n").over(upto)).join(more.where("more > 0"), ["key", "size"])
    edge = run.where("upto >= more AND upto - n < more").select("key", "size", F.col("bucket").alias("edge"), (F.col("more") - F.col("upto") + F.col("n")).alias("last"))
    marked = rows.join(edge, ["key", "size"], "left")
    ranked = marked.where("bucket = edge").withColumn("place", F.row_number().over(Window.partitionBy("key", "size").orderBy("draw", "doc_id")))
    extra = F.when(F.col("edge").isNull(), 0).when(F.col("bucket") < F.col("edge"), 1).otherwise(0)
    both = marked.where("edge IS NULL OR bucket <> edge").withColumn("extra", extra).drop("edge", "last")
    both = both.unionByName(ranked.withColumn("extra", (F.col("place") <= F.col("last")).cast("int")).drop("edge", "last", "place"))
    out = both.join(F.broadcast(given), "key").withColumn("passes", F.col("whole") + F.col("extra"))
    return out.select("doc_id", "source", "size", "source_size", "target", "passes", (F.col("size") * F.col("passes")).alias("taken"))
