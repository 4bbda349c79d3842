"""Near duplicates among vectors of one label, by a forest of random-projection trees.

Each tree splits the space by random directions at a sampled median; vectors near
a split go to both sides (spill), so close pairs are rarely parted, and many trees
make a pair that some tree parts meet in another. Vectors are compared within
leaves only; every similarity is verified in double precision.

A pair meets in several leaves. It counts in the first of the leaves that both
vectors are in, which each vector's list of leaves tells, so no pair is ever written
out: a leaf yields each vector's number of links and the smallest vector that the links
inside the leaf join it to.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnscore.llm.shared import components
from txnscore.session import materialize


@dataclass(frozen=True)
class Forest:
    """``sample`` vectors at most are sent to the driver to place the splits; every vector is indexed.

    ``spill`` is the half width, in projected length of unit vectors, of the band that goes
    to both sides. Leaves aim at ``leaf`` vectors of a label. The first ``deepest`` levels are
    placed by the driver's sample; a leaf that still has more than ``cell`` vectors is split
    on by up to eight levels, fitted in a task on about ``cell`` of its own vectors, and so
    on. What no split makes smaller, a cluster tighter than the spill, is compared in blocks
    of ``cell`` vectors, each pair of blocks a task of its own.
    """

    trees: int = 8
    least: float = 0.93
    spill: float = 0.04
    sample: int = 40_000
    leaf: int = 1024
    cell: int = 4096
    deepest: int = 10
    seed: int = 5


def fit(vectors: np.ndarray, depth: int, forest: Forest) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Per tree and level the directions and thresholds of the nodes of that level."""
    out, rng = [], np.random.default_rng(forest.seed)
    for _ in range(forest.trees):
        levels, node = [], np.zeros(len(vectors), np.int64)
        for level in range(depth):
            direction = rng.standard_normal((1 << level, vectors.shape[1]))
            direction /= np.linalg.norm(direction, axis=1, keepdims=True)
            at = np.einsum("ij,ij->i", vectors, direction[node])
            cut = np.array([np.median(at[node == k]) if (node == k).any() else 0.0 for k in range(1 << level)])
            levels.append((direction, cut))
            node = node * 2 + (at > cut[node])
        out.append(levels)
    return out


def leaves(model, vectors: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every vector in every tree, in order of row and leaf; spilt vectors have several leaves in a tree."""
    rows, places = [], []
    for t, levels in enumerate(model):
        row, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        for direction, cut in levels:
            off = np.einsum("ij,ij->i", vectors[row], direction[node]) - cut[node]
            left, right = off <= spill, off > -spill
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([node[left] * 2, node[right] * 2 + 1])
        rows.append(row)
        places.append((t << len(levels)) + node)
    # Numbers from a power of two on, so that those of split leaves, which are longer, are others.
    row, place = np.concatenate(rows), np.concatenate(places) + _base(model)
    order = np.lexsort((place, row))
    return row[order], place[order]


def _base(model) -> int:
    return 1 << (len(model) << len(model[0])).bit_length()


# Further levels of a round, and the vectors that place them: some sixteen for each node.
SUB_LEVELS = 8
SUB_SAMPLE = 16 << SUB_LEVELS


def _sub_directions(leaf: int, level: int, width: int, seed: int) -> np.ndarray:
    direction = np.random.default_rng([seed, leaf, level]).standard_normal((1 << level, width))
    return direction / np.linalg.norm(direction, axis=1, keepdims=True)


def sub_fit(leaf: int, vectors: np.ndarray, size: int, forest: Forest) -> list[np.ndarray]:
    """The thresholds of further levels below a leaf of ``size`` vectors, from some of them.

    A node that the spill would keep together has none (infinity: all go left).
    """
    held, cuts = {0: np.arange(len(vectors))}, []
    # What takes several rounds is shared among them, so that the last ends at ``forest.leaf`` too.
    levels = max(1, int(np.ceil(np.log(max(size, 1) / forest.leaf) / np.log(1 / 0.55))))
    levels = -(-levels // -(-levels // SUB_LEVELS))
    while len(cuts) < levels and max(len(x) for x in held.values()) * size > forest.leaf * len(vectors):
        direction, cut, below = _sub_directions(leaf, len(cuts), vectors.shape[1], forest.seed), np.full(1 << len(cuts), np.inf), {}
        for node, own in held.items():
            at = vectors[own] @ direction[node]
            middle = np.median(at) if len(own) else np.inf
            left, right = own[at <= middle + forest.spill], own[at > middle - forest.spill]
            if len(own) < 8 or max(len(left), len(right)) > 0.9 * len(own):
                below[2 * node] = own
                continue
            cut[node] = middle
            below[2 * node], below[2 * node + 1] = left, right
        held = below
        cuts.append(cut)
        if np.isinf(cut).all():
            break
    return cuts


def sub_leaves(leaf: int, vectors: np.ndarray, cuts: list[np.ndarray], forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every vector of a leaf after its further levels."""
    row, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    for level, cut in enumerate(cuts):
        direction = _sub_directions(leaf, level, vectors.shape[1], forest.seed)
        off = np.einsum("ij,ij->i", vectors[row], direction[node]) - cut[node]
        left, right = off <= forest.spill, off > -forest.spill
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([node[left] * 2, node[right] * 2 + 1])
    return row, (np.int64(leaf) << (SUB_LEVELS + 1)) | node


def split_on(placed: DataFrame, label: str, kind: str, forest: Forest) -> DataFrame:
    """``placed`` with every leaf of more than ``forest.cell`` vectors replaced by its sub-leaves, again and again.

    A round only moves the vectors of such leaves; each leaf is fitted on a hashed share of
    its vectors and placed by its own thresholds, joined by leaf. Leaves that a round leaves at
    nine tenths of their size or more are not tried again.
    """
    rows = placed.select("vec", "label", "copies", "embedding")
    at = placed.select("vec", "label", F.explode("leaves").alias("leaf"))
    sizes = at.groupBy("label", "leaf").agg(F.count("*").alias("n"))
    large = materialize(sizes.where(F.col("n") > forest.cell), "large-leaves")
    if large.isEmpty():
        return placed
    cuts_type = "array<array<double>>"

    def fitted(key, table):
        vectors, _ = _matrix(table["embedding"])
        cuts = sub_fit(key[1].as_py(), vectors, table["n"][0].as_py(), forest)
        return pa.table({"label": [key[0].as_py()], "leaf": [key[1].as_py()], "cuts": [[c.tolist() for c in cuts]]}).cast(_fitted_schema(table))

    def placed_on(batches):
        for batch in batches:
            leaf = batch["leaf"].to_numpy()
            rows, found = [], []
            for one in np.unique(leaf).tolist():
                own = np.flatnonzero(leaf == one)
                vectors, _ = _matrix(batch["embedding"].take(pa.array(own)))
                cuts = [np.array(c) for c in batch["cuts"][int(own[0])].as_py()]
                row, sub = sub_leaves(one, vectors, cuts, forest)
                rows.append(own[row])
                found.append(sub)
            row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([taken["vec"], taken["label"], pa.array(np.concatenate(found) if found else row), taken["leaf"], taken["n"]], ["vec", "label", "leaf", "was", "n_was"])

    while not large.isEmpty():
        inside = at.join(large, ["label", "leaf"]).join(rows.select("vec", "embedding"), "vec")
        share = F.pmod(F.xxhash64("vec", "leaf"), F.lit(1 << 20)) < SUB_SAMPLE / F.col("n") * (1 << 20)
        models = inside.where(share).groupBy("label", "leaf").applyInArrow(fitted, f"label {label}, leaf long, cuts {cuts_type}")
        models = materialize(models.where("size(cuts) > 0"), "leaf-splits")
        moved = inside.join(models, ["label", "leaf"]).mapInArrow(placed_on, f"vec long, label {label}, leaf long, was long, n_was long")
        moved = materialize(moved, "leaf-moves")
        stay = at.join(models.select("label", "leaf"), ["label", "leaf"], "left_anti")
        at = materialize(stay.unionByName(moved.select("vec", "label", "leaf")), "leaf-places")
        sizes = moved.groupBy("label", "leaf").agg(F.count("*").alias("n"), F.first("n_was").alias("n_was"))
        large = materialize(sizes.where((F.col("n") > forest.cell) & (F.col("n") < 0.9 * F.col("n_was"))).select("label", "leaf", "n"), "large-leaves")
    # A vector has some leaves in every tree; their order is that of their numbers.
    own = at.groupBy("vec").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    return materialize(rows.join(own, "vec").select("vec", "label", "copies", "embedding", "leaves"), "vector-leaves")


def _fitted_schema(table: pa.Table) -> pa.Schema:
    return pa.schema([("label", table.schema.field("label").type), ("leaf", pa.int64()), ("cuts", pa.list_(pa.list_(pa.float64())))])


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as unit rows in double precision, and which rows are usable."""
    lists = column.to_pylist()
    width = max((len(x) for x in lists if x), default=0)
    out, usable = np.zeros((len(lists), width)), np.zeros(len(lists), bool)
    for k, x in enumerate(lists):
        if x and len(x) == width and None not in x:
            out[k], usable[k] = x, True
    usable &= np.isfinite(out).all(axis=1)
    out[~usable] = 0
    out /= np.maximum(np.abs(out).max(axis=1, initial=0), 1e-300)[:, None]
    length = np.linalg.norm(out, axis=1)
    usable &= length > 0
    return out / np.where(length > 0, length, 1)[:, None], usable


_LINKED = pa.schema([("vec", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])
STRIP = 512


def _cell(forest: Forest, leaf: int, table: pa.Table, both: bool) -> pa.Table:
    """One leaf, or two blocks of one: per vector its links that count here and the smallest vector it is joined to.

    ``both``: the table has two blocks, to be compared with each other only.
    """
    vector, _ = _matrix(table["embedding"])
    vec, copies = table["vec"].to_numpy(), table["copies"].to_numpy()
    # Which earlier leaves each vector is in: a pair that shares one has been counted there.
    places = table["leaves"].combine_chunks()
    of = np.repeat(np.arange(len(vec)), np.diff(places.offsets.to_numpy()))
    place = places.flatten().to_numpy()
    of, place = of[place < leaf], place[place < leaf]
    _, column, count = np.unique(place, return_inverse=True, return_counts=True)
    # Only a leaf that two of them are in can have met a pair.
    met = count > 1
    earlier = np.zeros((len(vec), int(met.sum())), np.float32)
    own = met[column]
    earlier[of[own], (np.cumsum(met) - 1)[column[own]]] = 1
    side = table["side"].to_numpy() if both else np.zeros(len(vec), np.int64)
    rows = np.flatnonzero(side == 0)
    others = np.flatnonzero(side == 1) if both else rows
    links, least = np.zeros(len(vec), np.int64), vec.copy()
    linked = np.zeros((len(rows), len(others)), bool)
    for a in range(0, len(rows), STRIP):
        own = rows[a : a + STRIP]
        near = vector[own] @ vector[others].T >= forest.least
        if not both:
            near[np.arange(len(own)), a + np.arange(len(own))] = False
        if not near.any():
            continue
        linked[a : a + STRIP] = near
        fresh = near & (earlier[own] @ earlier[others].T == 0)
        links[own] += fresh @ copies[others]
        if both:
            links[others] += copies[own] @ fresh
    # The smallest vector reachable inside the cell: hand on the smallest linked one until nothing changes.
    most = np.iinfo(np.int64).max
    while linked.any():
        before = least.copy()
        for a in range(0, len(rows), STRIP):
            own, near = rows[a : a + STRIP], linked[a : a + STRIP]
            least[own] = np.minimum(least[own], np.where(near, least[others], most).min(axis=1))
            least[others] = np.minimum(least[others], np.where(near, least[own][:, None], most).min(axis=0))
        if (least == before).all():
            break
    keep = (least < vec) | (links > 0)
    return pa.table({"vec": vec[keep], "links": links[keep], "least": least[keep]}, schema=_LINKED)


def link(vectors: DataFrame, forest: Forest = Forest(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row.

    Vectors are compared if their labels are equal and not NULL; similar from cosine
    ``forest.least`` on. NULL and zero vectors, and those with NULL or non-finite components,
    link with nothing, nor do vectors of different lengths. Equal vectors of a label are one
    point with copies: they link with each other and share all other links. ``component_id``
    is the smallest id reachable over links. A row with a NULL id links like any other but
    never names a component that has another id. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.select(vector_col).schema[0].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"), F.col(label_col).alias("label"))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound & finite, F.lit(False)))
    # Equal vectors are one point, known by a number.
    points = rows.where("sound").groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    points = materialize(points.withColumns({"vec": F.monotonically_increasing_id(), "width": F.size("embedding")}), "vector-points")
    shapes = points.groupBy("label", "width").agg(F.count("*").alias("n")).groupBy("width").agg(F.max("n").alias("n"), F.sum("n").alias("all")).collect()
    found = None
    for shape in sorted(shapes, key=lambda r: r["width"]):
        part = _links(points.where(F.col("width") == shape["width"]), shape["n"], shape["all"], forest)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "vec long, links long, least long")
    found = materialize(found, "vector-links")
    roots = components(found.where("least < vec").select(F.col("vec").alias("a"), F.col("least").alias("b")), "vectors")
    counted = points.join(found.groupBy("vec").agg(F.sum("links").alias("links")), "vec", "left").join(roots.withColumnRenamed("node", "vec"), "vec", "left")
    counted = counted.select("label", "embedding", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "vec").alias("root"))
    names = counted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = counted.join(names, "root").select("label", "embedding", "n_links", "component_id")
    linked = rows.where("sound").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(points: DataFrame, most: int, total: int, forest: Forest) -> DataFrame:
    """(vec, links, least) of every leaf, for points of one width."""
    spark = points.sparkSession
    # Spill keeps leaves from halving at each level; a bounded sample places the splits.
    depth = 0
    while depth < forest.deepest and most * 0.6**depth > forest.leaf:
        depth += 1
    share = min(1.0, forest.sample / max(1, total))
    picked = points.where(F.pmod(F.xxhash64("vec", F.lit(forest.seed)), F.lit(1 << 20)) < share * (1 << 20))
    sample, _ = _matrix(pa.chunked_array([pa.array(picked.select("embedding").limit(2 * forest.sample).toPandas()["embedding"], pa.list_(pa.float64()))]))
    if not len(sample):
        depth = 0
    model = spark.sparkContext.broadcast(fit(sample, depth, forest) if depth else [[] for _ in range(1)])

    def place(batches):
        for batch in batches:
            unit, _ = _matrix(batch["embedding"])
            row, leaf = leaves(model.value, unit, forest.spill)
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(leaf))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("vec", "label", "copies", "embedding")), lists], ["vec", "label", "copies", "embedding", "leaves"])

    label, kind = (points.schema[c].dataType.simpleString() for c in ("label", "embedding"))
    placed = materialize(points.select("vec", "label", "copies", "embedding").mapInArrow(place, f"vec long, label {label}, copies long, embedding {kind}, leaves array<long>"), "vector-leaves")
    each = split_on(placed, label, kind, forest).withColumn("leaf", F.explode("leaves"))
    sizes = each.groupBy("label", "leaf").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / forest.cell).cast("int"))
    sizes = materialize(sizes.where("n > 1").drop("n"), "leaf-sizes")
    each = each.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, ["label", "leaf"])
    small = each.where("blocks = 1").drop("blocks").groupBy("label", "leaf").applyInArrow(lambda key, t: _cell(forest, key[1].as_py(), t, False), "vec long, links long, least long")
    # A leaf of several blocks: every pair of blocks is a cell that both are sent to.
    block = F.pmod(F.xxhash64("vec", F.lit(forest.seed + 1)), F.col("blocks")).cast("int")
    large = each.where("blocks > 1").withColumn("block", block)
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("one"), F.greatest(k, "block").alias("two"), (F.col("block") > k).cast("long").alias("side")))
    large = large.withColumn("cell", F.explode(cells)).select("*", "cell.*").drop("cell", "blocks", "block")

    def compare(key, table):
        return _cell(forest, key[1].as_py(), table, key[2].as_py() != key[3].as_py())

    return small.unionByName(large.groupBy("label", "leaf", "one", "two").applyInArrow(compare, "vec long, links long, least long"))
