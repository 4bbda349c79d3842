"""Near-duplicate documents by the Jaccard similarity of their word shingles.

Two sets as similar as the threshold share a token among the first
n - ceil(threshold * n) + 1 tokens of each, under any order of all tokens, and with
l - 1 tokens more they share l. Under several orders, all of these filters hold at once:

1. The first order is that of frequency, rarest first, counted over all different
   texts: buckets of texts report their shingles, slices of the shingles count them
   and tell the buckets which occur twice. Prefix tokens that occur once have nothing
   to meet and go no further. Documents with the same set are one class.
2. The classes of a token are paired with the one among them that meets most others
   (a star, linear in the group). A pair is a candidate only if its prefixes under
   the other orders share as many tokens as they must, which short sketches of these
   prefixes tell; only the sets of candidates are moved, and intersected exactly.
3. Classes that the stars left in different components and that still share a
   prefix token are paired with each other, filtered and verified the same way, or
   compared in blocks where very many share one.
   Whatever is left unverified lies within one component already, so components
   are those of the full similarity graph, though no group emits all its pairs.

A shingle is known by a 64-bit hash of its words, a set by 64 bits of a digest.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnscore.llm import shared, windows
from txnscore.session import materialize

CHUNK = 1 << 20
FEW_KEYS = 1_000_000
# Tokens of more classes than PAIRED are compared in blocks of about BLOCK classes or
# BLOCK_BYTES of sets, not as pairs.
PAIRED, BLOCK, BLOCK_BYTES = 32, 1024, 8 << 20
ORDERS = tuple(np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707345, 0xA4093822299F31D1))


@dataclass(frozen=True)
class Near:
    """Shingles of ``words`` words; similar from ``percent`` % on."""

    words: int = 5
    percent: int = 80
    bucket_bytes: int = 8 << 20

    def prefix(self, n: int) -> int:
        """Of these tokens a set shares one with any similar set."""
        return n + (-n * self.percent) // 100 + 1

    def indexed(self, n: int) -> int:
        """And of these one with any similar set that is not smaller."""
        return n + (-2 * n * self.percent) // (100 + self.percent) + 1

    def reach(self, n: int) -> int:
        """Tokens of a set that its sketch has under each order."""
        return min(n, -(-2 * n * (100 - self.percent) // 100))


def shingle_sets(near: Near, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every text, ascending, and the offsets of the texts among them."""
    low = shared.ASCII_LOWER[data]
    start, end, rows = shared.words_of(low, offsets)
    words = shared.word_hashes(low, start, end)
    size = np.diff(rows)
    grams = shared.mix(shared.rolling(words, near.words))
    doc = np.repeat(np.arange(len(size)), size)
    whole = np.arange(len(grams)) + near.words <= rows[doc[: len(grams)] + 1]
    value, doc = grams[whole], doc[: len(grams)][whole]
    # Fewer words than a shingle has: all of them are one.
    short = np.flatnonzero((size > 0) & (size < near.words))
    for r in short.tolist():
        part = words[rows[r] : rows[r + 1]]
        value = np.append(value, shared.mix(shared.rolling(part, len(part)) + np.uint64(len(part))))
    doc = np.append(doc, short)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return value, np.searchsorted(doc, np.arange(len(size) + 1))


def class_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(near: Near, data: np.ndarray, offsets: np.ndarray):
    """(row, shingles, class) of every text that has words."""
    for a, b in shared.chunks(offsets, CHUNK):
        lo = offsets[a]
        value, at = shingle_sets(near, data[lo : offsets[b]], offsets[a : b + 1] - lo)
        for r in np.flatnonzero(np.diff(at)).tolist():
            own = value[at[r] : at[r + 1]]
            yield r + a, own, class_of(own)


@shared.frugal
def _report(near: Near, slices: int, table: pa.Table) -> dict:
    """The shingles of a bucket's classes by slice, each once, with the number of classes that have it."""
    _, data, offsets, _ = windows.documents(table)
    seen: dict[int, np.ndarray] = {}
    for _, own, kind in _sets(near, data, offsets):
        seen.setdefault(kind, own)
    token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *seen.values()]), return_counts=True)
    present, ranges = windows.sliced(token, slices)
    # Kept to 48 bits, as differences: equal bits make a shingle seem more frequent, no more.
    return {
        "slice": present.tolist(),
        "size": [y - x for x, y in ranges],
        "tokens": [windows.packed(np.diff(token[x:y] >> np.uint64(16), prepend=np.uint64(0))) for x, y in ranges],
        "counts": [windows.packed(n[x:y].astype(np.uint32)) for x, y in ranges],
    }


@shared.frugal
def _counted(table: pa.Table) -> dict:
    """Of one slice, the shingles that occur in two classes, with their frequency, for each bucket that has them."""
    sizes, buckets = table["size"].to_pylist(), table["bucket"].to_pylist()
    token = np.concatenate([np.cumsum(windows.unpacked(x, np.uint64, n), dtype=np.uint64) for x, n in zip(table["tokens"].to_pylist(), sizes)])
    n = np.concatenate([windows.unpacked(x, np.uint32, n) for x, n in zip(table["counts"].to_pylist(), sizes)])
    of = np.repeat(np.arange(len(sizes)), sizes)
    unique, back = np.unique(token, return_inverse=True)
    total = np.bincount(back, n, len(unique))[back].astype(np.int64)
    common = total > 1
    token, total, of = token[common], np.minimum(total[common], 2**32 - 1).astype(np.uint32), of[common]
    edges = np.searchsorted(of, np.arange(len(sizes) + 1))
    out = {"bucket": [], "size": [], "tokens": [], "counts": []}
    for k, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if y > x:
            out["bucket"].append(buckets[k])
            out["size"].append(y - x)
            out["tokens"].append(windows.packed(np.diff(token[x:y], prepend=np.uint64(0))))
            out["counts"].append(windows.packed(total[x:y]))
    return out


_CLASSED = pa.schema(
    [("digest", pa.binary()), ("class", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64())), ("indexed", pa.list_(pa.bool_())), ("sketch", pa.binary()), ("shingles", pa.binary())]
)


@shared.frugal
def _classes(near: Near, docs: pa.Table, marks: pa.Table) -> pa.Table:
    """A row for every text of a bucket; with tokens, sketch and set if its class has a prefix token that others have."""
    _, data, offsets, rows = windows.documents(docs)
    known, often = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for n, tokens, counts in zip(*(marks[c].to_pylist() for c in ("size", "tokens", "counts"))):
        known.append(np.cumsum(windows.unpacked(tokens, np.uint64, n), dtype=np.uint64))
        often.append(windows.unpacked(counts, np.uint32, n))
    known, often = np.concatenate(known), np.concatenate(often).astype(np.uint64)
    order = np.argsort(known)
    known, often = np.append(known[order], np.uint64(2**64 - 1)), np.append(often[order], np.uint64(1))
    blank = {"class": None, "n": 0, "tokens": [], "indexed": [], "sketch": None, "shingles": None}
    out = [{"digest": d, **blank} for d in rows["digest"].to_pylist()]
    seen: set[int] = set()
    for row, own, kind in _sets(near, data, offsets):
        n = len(own)
        out[row].update({"class": kind, "n": n})
        if kind in seen:
            continue
        seen.add(kind)
        at = np.searchsorted(known, own >> np.uint64(16))
        met = known[at] == own >> np.uint64(16)
        times = np.where(met, np.minimum(often[at], np.uint64(2**23 - 1)), np.uint64(1))
        first = np.argsort(times << np.uint64(40) | shared.mix(own ^ ORDERS[0]) >> np.uint64(24), kind="stable")[: near.prefix(n)]
        common = np.flatnonzero(times[first] > 1)
        if len(common):
            out[row].update({"tokens": own[first[common]].view(np.int64).tolist(), "indexed": (common < near.indexed(n)).tolist(), "sketch": sketch(near, own), "shingles": own.tobytes()})
    return pa.Table.from_pylist(out, _CLASSED)


def sketch(near: Near, own: np.ndarray) -> bytes:
    """The first tokens of a set under each other order, twice as many as the plain prefix, 16 bits of each."""
    n = near.reach(len(own))
    return b"".join((np.sort(shared.mix(own ^ order))[:n] & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for order in ORDERS[1:])


def passes(near: Near, n_a: int, a: bytes, n_b: int, b: bytes) -> bool:
    """Whether the sketches of two sets leave it open that they are similar.

    With a required overlap of o, the first n - o + l tokens of each share l of them. The
    16 bits only ever make tokens equal that are not.
    """
    overlap = -(-near.percent * (n_a + n_b) // (100 + near.percent))
    k_a, k_b = near.reach(n_a), near.reach(n_b)
    least = min(k_a - n_a, k_b - n_b) + overlap
    if least < 1:
        return True
    head_a, head_b = n_a - overlap + least, n_b - overlap + least
    a, b = np.frombuffer(a, np.uint16).reshape(-1, k_a), np.frombuffer(b, np.uint16).reshape(-1, k_b)
    for x, y in zip(a, b):
        met = int(np.isin(x[:head_a], y[:head_b]).sum())
        if met < least:
            return False
    return True


def similar(near: Near, a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= near.percent * (len(a) + len(b) - both)


def _small(keys: DataFrame) -> DataFrame:
    """A stored table of keys (two numbers at most), to be sent to all tasks if it has few rows.

    That keeps a semi-join from moving the wide side; with more rows it is an ordinary join.
    """
    return F.broadcast(keys) if keys.count() <= FEW_KEYS else keys


def _verified(near: Near, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The similar ones of some pairs of classes (a, b): sizes, then sketches, then sets are compared."""

    @shared.frugal
    def candidates(batches):
        for batch in batches:
            keep = [passes(near, *x) for x in zip(*(batch[c].to_pylist() for c in ("n_a", "one", "n_b", "two")))]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    @shared.frugal
    def exact(batches):
        for batch in batches:
            keep = [similar(near, np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch["one"].to_pylist(), batch["two"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def sides(column: str) -> list[DataFrame]:
        names = (("a", "n_a", "one"), ("b", "n_b", "two"))
        return [sets.select(F.col("class").alias(k), F.col("n").alias(n), F.col(column).alias(c)) for k, n, c in names]

    one, two = sides("sketch")
    near_sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * near.percent
    sized = pairs.join(one.drop("one"), "a").join(two.drop("two"), "b").where(near_sized)
    open_ = sized.join(one.drop("n_a"), "a").join(two.drop("n_b"), "b").mapInArrow(candidates, "a long, b long")
    open_ = materialize(open_, "candidates")
    met = _small(materialize(open_.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "candidate-classes"))
    sets = sets.join(met, "class", "left_semi")
    one, two = sides("shingles")
    return open_.join(one, "a").join(two, "b").mapInArrow(exact, "a long, b long")


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as a column ``row``, with what tells rows apart: a digest of the text and the id (NULL last)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.struct("*").alias("row"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.coalesce(F.col(id_col).cast("long"), F.lit(windows.NO_ID)).alias("id_key")
    )


def _stars(groups: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b) of each token's classes with the one that meets most others."""
    sizes = groups.groupBy("token").agg(F.count("*").alias("m"))
    weights = groups.join(sizes, "token").groupBy("class").agg(F.sum(F.col("m") - 1).alias("weight"))
    weighed = groups.join(weights, "class")
    hubs = weighed.groupBy("token").agg(F.max(F.struct("weight", "class", "n", "indexed")).alias("hub"))
    pairs = groups.join(hubs.select("token", "hub.class", "hub.n", "hub.indexed").toDF("token", "a", "n_a", "indexed_a"), "token")
    return pairs.where(F.col("class") != F.col("a")).where(_may_match("n_a", "indexed_a", "n", "indexed", near)).select("a", F.col("class").alias("b")).distinct()


def _may_match(n_a: str, indexed_a: str, n_b: str, indexed_b: str, near: Near) -> str:
    """Sizes fit, and the token is among the indexed ones of the smaller set."""
    sizes = f"least({n_a}, {n_b}) * 100 >= greatest({n_a}, {n_b}) * {near.percent}"
    return f"{sizes} AND (({n_a} <= {n_b} AND {indexed_a}) OR ({n_b} <= {n_a} AND {indexed_b}))"


def _crowds(near: Near, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among the classes of tokens that very many share, enough to connect what is similar.

    Such classes are gathered by the components of "shares such a token" and compared in
    blocks, every pair of blocks in a task of its own, so that no pair is ever a row.
    """
    hubs = groups.groupBy("token").agg(F.min("class").alias("b"))
    crowds = shared.components(groups.join(hubs, "token").select(F.col("class").alias("a"), "b"), "crowds")
    rows = groups.select("class", "root").distinct().join(crowds.toDF("class", "crowd"), "class", "left")
    rows = materialize(rows.withColumn("crowd", F.coalesce("crowd", "class")), "crowds")
    rows = rows.join(sets.select("class", "n", "shingles"), "class")
    # A shingle is eight bytes: long texts make more and smaller blocks.
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, 8 * F.sum("n") / BLOCK_BYTES)).cast("int")
    sizes = rows.groupBy("crowd").agg(blocks.alias("blocks"))
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, "block").alias("one"), F.greatest(k, "block").alias("two"), (F.col("block") > k).cast("int").alias("side")),
    )
    dealt = rows.join(sizes, "crowd").withColumn("block", block).select("crowd", "class", "root", "shingles", F.inline(cells))
    return dealt.groupBy("crowd", "one", "two").applyInArrow(lambda t: _compared(near, t), "a long, b long")


@shared.frugal
def _compared(near: Near, table: pa.Table) -> pa.Table:
    """The similar pairs of one block or of two, with different roots: each class with the least it is joined to."""
    kinds, first = np.unique(table["class"].to_numpy(), return_index=True)
    table = table.take(pa.array(first))
    side, root = table["side"].to_numpy(), table["root"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
    size = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), size)
    token, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Only shingles of two sets add to an intersection; some thousands at a time.
    number = np.cumsum(count > 1) - 1
    held = count[column] > 1
    of, column = of[held], number[column[held]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for x in range(0, int((count > 1).sum()), 4096):
        lo, hi = np.searchsorted(column, (x, x + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[of[lo:hi], column[lo:hi] - x] = 1
        both += part @ part.T
    similar_ = 100 * both >= near.percent * (size[:, None] + size[None] - both)
    similar_ &= root[:, None] != root[None]
    if side.any():
        similar_ &= side[:, None] != side[None]
    # Least class reachable within the task, by handing on the least neighbour.
    least = np.arange(len(sets))
    while True:
        near_least = np.where(similar_, least[None], len(sets)).min(axis=1, initial=len(sets))
        now = np.minimum(least, near_least)
        if (now == least).all():
            break
        least = now
    moved = least != np.arange(len(sets))
    return pa.table({"a": kinds[moved], "b": kinds[least[moved]]})


def linked(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row its ``doc_id``, ``digest``, ``id_key``, ``n``, ``class`` and the ``root`` of its component."""
    keyed = _keys(docs, id_col, text_col)
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(8, -(-total // near.bucket_bytes))
    tasks = min(buckets, windows.MOST_TASKS)
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")
    doc_id = F.col(f"row.`{id_col}`").cast("long").alias("doc_id")
    thin = keyed.select(bucket, "digest", doc_id, "id_key", text.alias("text")).mapInArrow(windows.thin, windows.THIN)
    dealt = thin.repartition(tasks, "bucket")

    numbers = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("size", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())])

    def report(key, table):
        columns = _report(near, buckets, table)
        columns["bucket"] = [key[0].as_py()] * len(columns["slice"])
        return pa.table({f.name: pa.array(columns[f.name], f.type) for f in numbers})

    reported = dealt.groupBy("bucket").applyInArrow(report, "slice long, bucket int, size long, tokens binary, counts binary")
    marked = pa.schema([f for f in numbers if f.name != "slice"])
    marks = reported.repartition(tasks, "slice").groupBy("slice").applyInArrow(lambda t: pa.table(_counted(t), marked), "bucket int, size long, tokens binary, counts binary")
    columns = "digest binary, class long, n long, tokens array<long>, indexed array<boolean>, sketch binary, shingles binary"
    classes = dealt.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(lambda t, m: _classes(near, t, m), columns)
    classes = materialize(classes, "shingle-classes")

    sets = classes.where("sketch IS NOT NULL").select("class", "n", "sketch", "shingles")
    each = classes.where("sketch IS NOT NULL").select("class", "n", F.inline(F.arrays_zip("tokens", "indexed")))
    groups = each.select(F.col("tokens").alias("token"), "class", "n", "indexed").dropDuplicates(["token", "class"])
    groups = materialize(groups, "shared-tokens")
    edges = materialize(_verified(near, _stars(groups, near), sets), "star-links")
    joined = shared.components(edges, "stars")
    # What the stars left apart: classes of one token in different components.
    placed = groups.join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    split = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    placed = materialize(placed.join(split, "token"), "split-tokens")
    sizes = placed.groupBy("token").agg(F.count("*").alias("m"))
    few = placed.join(sizes.where(F.col("m") <= PAIRED).select("token"), "token", "left_semi")
    one, two = (few.select("token", *(F.col(c).alias(f"{c}_{k}") for c in ("class", "root", "n", "indexed"))) for k in "ab")
    apart = one.join(two, "token").where("root_a < root_b").where(_may_match("n_a", "indexed_a", "n_b", "indexed_b", near))
    more = _verified(near, apart.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct(), sets)
    many = placed.join(sizes.where(F.col("m") > PAIRED).select("token"), "token", "left_semi")
    joined = shared.components(edges.unionByName(more).unionByName(_crowds(near, many, sets)), "links")
    rows = keyed.select(doc_id, "digest", "id_key").join(classes.select("digest", "n", "class"), "digest")
    return rows.join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def near_duplicates(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links; rows with the same set are
    linked. Rows without words (NULL, empty or blank texts) have no shingles and are their
    own component. Ids may repeat or be NULL: each row is judged by its text, and NULL ids
    are never the smallest (a group without any other has a NULL one). Other columns are not read.
    """
    rows = linked(docs, near, id_col, text_col)
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    return rows.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), component)


def keep_one(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of near duplicates, that of the smallest id, with all columns of ``docs``.

    Rows without words all stay. Of rows that agree in id and text, any one stays.
    """
    rows = materialize(linked(docs, near, id_col, text_col), "linked-rows")
    first = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("id_key", "digest")).alias("row")).select("row.*")
    blank = rows.where("root IS NULL").select("id_key", "digest").distinct()
    whole, key = _keys(docs, id_col, text_col), ["digest", "id_key"]
    stay = whole.join(_small(materialize(first, "rows-that-stay")), key, "left_semi").dropDuplicates(key)
    return stay.unionByName(whole.join(_small(materialize(blank, "blank-rows")), key, "left_semi")).select("row.*")
