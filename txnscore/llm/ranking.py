"""Ranked lexical search over a document-partitioned index, by Block-Max MaxScore.

Index: every task cuts its documents into shards of some megabytes of text and writes, for
each shard and term, one row: its postings (document numbers as gaps, occurrences) in
compressed blocks, with the last document and the highest contribution of every block. A
row with the empty term has the ids and length norms of the shard's documents. Nothing is
shuffled to build it.

Search: each list of an asked term meets the items that ask for it, and the lists of one
shard and one block of items meet in a task. There, an item's lists stand by their global
bound (weight times highest contribution). Those whose bounds together cannot lift a
document above the k-th best so far are non-essential; only documents of the other,
essential lists are candidates. A candidate's possible gain is then cut down to the block
maxima of the non-essential lists, and only what still may win has blocks of them
decompressed. The shards' best k are merged, each by its own hash group first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnscore.llm.runs import word_numbers
from txnscore.llm.shared import ASCII_LOWER, byte_column, frugal, release, text_rows, words_of
from txnscore.session import materialize

# Letters and digits of ASCII and everything beyond it make terms.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = np.zeros(256, bool)
GAP[:128] = [not chr(c).isalnum() for c in range(128)]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000
# Items that one search task serves; merge groups of shards.
ITEMS, GROUPS = 512, 1024


@dataclass(frozen=True)
class Layout:
    """``shard`` bytes of text make a shard (a longer text is one of its own), ``block`` postings a block."""

    shard: int = 16 << 20
    block: int = 128
    window: int = 2048


@dataclass(frozen=True)
class Index:
    """The lists, the number of documents that have terms, and the number of all their terms."""

    lists: DataFrame
    documents: int
    terms: int


def contribution(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term adds to a score, but for its weight."""
    return (SCALE * tf) // (1000 * tf + 20 * norm)


def norms(size: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The length norm of texts of ``size`` terms, in whole numbers of any width."""
    values, at = np.unique(size, return_inverse=True)
    return np.array([50 + 50 * n * documents // terms for n in values.tolist()], np.int64)[at]


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the last byte of a value below 128; and where each value ends."""
    width = np.ones(len(values), np.int64)
    for shift in range(7, 64, 7):
        more = values >> shift > 0
        if not more.any():
            break
        width += more
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(width.max()) if len(width) else 0):
        has = width > k
        last = width[has] == k + 1
        out[ends[has] - width[has] + k] = (values[has] >> (7 * k) & 127) | np.where(last, 0, 128)
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.append(0, last[:-1] + 1)
    width = last - first + 1
    out = (data[first] & 127).astype(np.int64)
    for k in range(1, int(width.max())):
        has = width > k
        out[has] |= (data[first[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


_LISTS = pa.schema(
    [
        ("shard", pa.int64()), ("term", pa.string()), ("docs", pa.int64()), ("most", pa.int64()),
        ("lasts", pa.binary()), ("maxima", pa.binary()), ("ends", pa.binary()), ("postings", pa.binary()),
    ]
)
_LIST_TYPES = "shard long, term string, docs long, most long, lasts binary, maxima binary, ends binary, postings binary"


def shard_lists(shard: int, ids: list, texts: list[bytes], documents: int, terms: int, block: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard; documents are numbered by their ids, NULL last."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    data = ASCII_LOWER[np.frombuffer(b"".join(texts[k] for k in order), np.uint8)]
    offsets = np.append(0, np.cumsum([len(texts[k]) for k in order], dtype=np.int64))
    start, end, rows = words_of(data, offsets, GAP)
    size = np.diff(rows)
    if not len(start):
        return
    number, names = word_numbers(data, start, end)
    n, kinds = len(order), len(names)
    pair, tf = np.unique(number * n + np.repeat(np.arange(n), size), return_counts=True)
    term, doc = pair // n, pair % n
    norm = norms(size, documents, terms)
    gain = contribution(tf, norm[doc])
    head = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    count = np.diff(np.append(head, len(term)))
    inside = np.arange(len(term)) - np.repeat(head, count)
    first = np.flatnonzero(inside % block == 0)
    length = np.diff(np.append(first, len(term)))
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]
    # A block's gaps stand before its occurrences.
    at = np.arange(len(term)) + np.repeat(first, length)
    values = np.zeros(2 * len(term), np.int64)
    values[at], values[at + np.repeat(length, length)] = gap, tf
    raw, ends = packed(values)
    stop = ends[2 * (first + length) - 1]
    blocks = -(-count // block)
    upto = np.cumsum(blocks)
    begins = np.append(0, stop[upto - 1])
    most = np.maximum.reduceat(gain, first)
    columns = [
        pa.array(np.full(kinds, shard)),
        names.cast(pa.large_string()).cast(pa.string()),
        pa.array(count.astype(np.int64)),
        pa.array(np.maximum.reduceat(gain, head)),
        _binary(doc[first + length - 1].astype("<i4"), 4 * upto),
        _binary(most.astype("<i4"), 4 * upto),
        _binary((stop - np.repeat(begins[:-1], blocks)).astype("<i4"), 4 * upto),
        _binary(raw, begins[1:]),
    ]
    whole = pa.RecordBatch.from_arrays(columns, schema=_LISTS)
    for k in range(0, kinds, 8192):
        yield whole.slice(k, 8192)
    known = np.array([ids[k] is not None for k in order])
    own = np.array([ids[k] or 0 for k in order], "<i8")
    about = [[shard], [""], [n], [0], [known.astype(np.uint8).tobytes()], [b""], [norm.astype("<i8").tobytes()], [own.tobytes()]]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(about, _LISTS.types)], schema=_LISTS)


def build(docs: DataFrame, layout: Layout = Layout(), id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of the whole texts of all rows, a stored table.

    Only A-Z are lower-cased. NULL texts and texts without a term are no documents. Rows
    of one id are documents of their own. An empty table gives an empty index.
    """
    texts = text_rows(docs, id_col, text_col)

    @frugal
    def sizes(batches):
        for batch in batches:
            size = np.diff(words_of(*byte_column(batch["text"]), GAP)[2])
            yield pa.RecordBatch.from_pydict({"documents": [int((size > 0).sum())], "terms": [int(size.sum())]})

    counted = texts.mapInArrow(sizes, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = counted[0] or 0, counted[1] or 0

    def lists(batches):
        ids, rows, held, shard = [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = byte_column(batch["text"])
            raw = data.tobytes()
            for k, doc_id in enumerate(batch["doc_id"].to_pylist()):
                text = raw[offsets[k] : offsets[k + 1]]
                if rows and held + len(text) > layout.shard:
                    yield from shard_lists(shard, ids, rows, documents, terms, layout.block)
                    ids, rows, held, shard = [], [], 0, shard + 1
                if text:
                    ids.append(doc_id)
                    rows.append(text)
                    held += len(text)
        if rows:
            yield from shard_lists(shard, ids, rows, documents, terms, layout.block)
        release()

    return Index(materialize(texts.mapInArrow(lists, _LIST_TYPES), "search-lists"), documents, terms)


class _List:
    """A term's postings in one shard, decompressed block by block when asked for."""

    def __init__(self, row: dict, norm: np.ndarray):
        self.weight, self.norm = int(row["weight"]), norm
        self.bound = self.weight * int(row["most"])
        self.lasts = np.frombuffer(row["lasts"], "<i4")
        self.maxima = np.frombuffer(row["maxima"], "<i4").astype(np.int64) * self.weight
        self.ends = np.append(0, np.frombuffer(row["ends"], "<i4"))
        self.data = np.frombuffer(row["postings"], np.uint8)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and what each gets from this list."""
        if k not in self.known:
            values = unpacked(self.data[self.ends[k] : self.ends[k + 1]])
            half = len(values) // 2
            doc = np.cumsum(values[:half])
            self.known[k] = (doc, self.weight * contribution(values[half:], self.norm[doc]))
        return self.known[k]

    def add(self, low: int, high: int, score: np.ndarray, hit: np.ndarray) -> None:
        """Add to the scores of the documents from ``low`` to below ``high``."""
        first, last = np.searchsorted(self.lasts, [low, high - 1])
        for k in range(int(first), min(int(last) + 1, len(self.lasts))):
            doc, gain = self.block(k)
            a, b = np.searchsorted(doc, [low, high])
            score[doc[a:b] - low] += gain[a:b]
            hit[doc[a:b] - low] = True

    def possible(self, docs: np.ndarray) -> np.ndarray:
        """The maximum of the block in which each document would be."""
        k = np.searchsorted(self.lasts, docs)
        return np.append(self.maxima, 0)[k]

    def gains(self, docs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        at = np.searchsorted(self.lasts, docs)
        for k in np.unique(at[at < len(self.lasts)]).tolist():
            own = np.flatnonzero(at == k)
            doc, gain = self.block(k)
            x = np.searchsorted(doc, docs[own])
            same = doc[x] == docs[own]
            out[own[same]] = gain[x[same]]
        return out


def best(lists: list[_List], n: int, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents of ``n`` with the highest scores above 0, equal scores by number, and the scores."""
    lists = sorted(lists, key=lambda x: x.bound)
    upto = np.cumsum([x.bound for x in lists])
    top, scores, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for low in range(0, n, window):
        high = min(n, low + window)
        # Later documents lose ties, so what can only reach the k-th score is out.
        split = int(np.searchsorted(upto, floor, "right"))
        if split == len(lists):
            break
        score, hit = np.zeros(high - low, np.int64), np.zeros(high - low, bool)
        for x in lists[split:]:
            x.add(low, high, score, hit)
        docs = np.flatnonzero(hit)
        score = score[docs]
        docs = docs + low
        if split:
            open_ = score + upto[split - 1] > floor
            docs, score = docs[open_], score[open_]
            hope = [x.possible(docs) for x in lists[:split]]
            rest = np.sum(hope, axis=0) if len(docs) else score
            for j in range(split - 1, -1, -1):
                open_ = score + rest > floor
                docs, score, rest = docs[open_], score[open_], rest[open_]
                hope = [h[open_] for h in hope[: j + 1]]
                if not len(docs):
                    break
                rest = rest - hope[j]
                score = score + lists[j].gains(docs)
        open_ = score > floor
        top, scores = np.append(top, docs[open_]), np.append(scores, score[open_])
        order = np.lexsort((top, -scores))[:k]
        top, scores = top[order], scores[order]
        if len(top) == k:
            floor = int(scores[-1])
    return top, scores


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item`` (the id as text, NULL as a mark of its own) and ``term``, each pair once."""
    text = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    named = items.select(item_key(F.col(id_col)).alias("item"), F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(0)).alias("terms"))
    return named.select("item", F.explode("terms").alias("term")).distinct()


def item_key(item_id: Column) -> Column:
    return F.coalesce(item_id.cast("long").cast("string"), F.lit("~"))


_HEAP = pa.schema([("item", pa.string()), ("shard", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_HEAP_TYPES = "item string, shard long, place long, doc_id long, score long"


def search(index: Index, items: DataFrame, k: int = 50, layout: Layout = Layout(), id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score``: the ``k`` best documents of every item.

    Only scores above 0 count; equal scores stand by ascending doc_id, NULL last (rows of
    one id are told apart by where they are stored). Rows of ``items`` with one id are one
    item with the terms of all. An item without terms, or whose terms no document has,
    gets no rows. Items are served in blocks, so neither they nor the lists of a shard
    for them ever meet in one place as a whole.
    """
    asked = materialize(item_terms(items, id_col, text_col), "search-terms")
    blocks = max(1, -(-asked.select("item").distinct().count() // ITEMS))
    df = index.lists.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("docs").alias("df"))
    odds = F.lit(float(2 * index.documents + 2)) / (2 * F.col("df") + 1)
    weighed = df.select("term", F.floor(1000 * F.log(odds)).cast("long").alias("weight"))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    asks = asked.groupBy(block.alias("block"), "term").agg(F.collect_list("item").alias("items"))
    asks = asks.join(weighed, "term")
    about = asks.select("block").distinct().select(F.lit("").alias("term"), "block", F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("weight"))
    # At most one row per term and block; Spark joins it by its size.
    asks = materialize(asks.select("term", "block", "items", "weight").unionByName(about), "search-asks")
    met = index.lists.join(asks, "term")

    def one_shard(key, table):
        rows = {r["term"]: r for r in table.to_pylist()}
        about = rows.pop("")
        norm, ids = np.frombuffer(about["ends"], "<i8"), np.frombuffer(about["postings"], "<i8")
        unknown = np.frombuffer(about["lasts"], np.uint8) == 0
        of: dict[str, list[_List]] = {}
        for r in rows.values():
            own = _List(r, norm)
            for item in r["items"]:
                of.setdefault(item, []).append(own)
        parts = []
        for item, lists in sorted(of.items()):
            top, scores = best(lists, len(ids), k, layout.window)
            same = pa.array([item] * len(top), pa.string()), pa.array([key[0].as_py()] * len(top), pa.int64())
            found = pa.array(top), pa.array(ids[top], pa.int64(), mask=unknown[top]), pa.array(scores)
            parts.append(pa.RecordBatch.from_arrays([*same, *found], schema=_HEAP))
        release()
        return pa.Table.from_batches(parts, _HEAP).combine_chunks()

    heaps = met.groupBy("shard", "block").applyInArrow(one_shard, _HEAP_TYPES)
    heaps = materialize(heaps, "search-heaps")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "shard", "place"]
    # A group of shards first, so that no task ever holds the heaps of all of them.
    group = F.pmod(F.xxhash64("shard"), F.lit(GROUPS)).cast("int")
    near = heaps.withColumn("group", group).withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order)))
    last = near.where(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return last.select(F.when(F.col("item") != "~", F.col("item").cast("long")).alias("item_id"), "rank", "doc_id", "score")
