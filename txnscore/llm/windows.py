"""Shared windows of fixed length: which windows of a text also stand at an earlier place.

The common plan of substring and suffix-array deduplication, for windows of W
units (bytes or words). It holds whatever one text repeats, because everything
is reduced per bucket of documents before it is shuffled:

0. Of exact copies only the one of smallest id goes on, each text at most once
   from each task; the windows of the others all stand in it.
1. Texts fall into buckets by digest. Every window is represented by the
   smallest hash among its g-unit grams (equal windows have equal ones, at equal
   places), so a bucket reports about one anchor in (W - g) / 2 units, each once.
2. Anchors are counted by slices of the hash. Those seen at least twice go back
   to the buckets they came from.
3. Buckets cut out the text around their shared anchors (all windows the anchor
   represents, one snippet), each different snippet once with its earliest place.
   An anchor in more than ``hot`` places may stand in as many contexts; its
   windows are cut one by one and dealt by the hash of the whole window, so no
   task meets all contexts of a common line.
4. A matcher per slice compares the snippets of each key and returns, for runs of
   windows, the earliest place of the same units anywhere.
5. Buckets put the answers on their documents.

The text is shuffled once (the exchange by bucket is reused); a slice or a bucket
is bounded by ``bucket_bytes``. Hashes only bring candidates together: matchers
compare the units themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnscore.llm import shared

CHUNK = 1 << 20
MOST_TASKS = 10_000
NO_ID = 2**63 - 1
_CODEC = pa.Codec("zstd")
THIN = "bucket int, digest binary, doc_id long, id_key long, text string, copies long"
_THIN = pa.schema([("bucket", pa.int32()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("id_key", pa.int64()), ("text", pa.string()), ("copies", pa.int64())])


@dataclass(frozen=True)
class Scheme:
    """Windows of ``window`` units, anchored by grams of ``gram`` units; ``words`` or bytes."""

    window: int
    gram: int
    words: bool
    hot: int = 20_000
    bucket_bytes: int = 8 << 20


class Units:
    """The units of a run of documents: their hashes, offsets by document, and places in the bytes."""

    def __init__(self, scheme: Scheme, data: np.ndarray, offsets: np.ndarray):
        self.raw = data.tobytes()
        if scheme.words:
            self.start, self.end, self.rows = shared.words_of(data, offsets)
            self.hash = shared.word_hashes(data, self.start, self.end)
        else:
            self.rows = offsets
            self.hash = shared.BYTE_VALUE[data]
        self.words = scheme.words

    def content(self, first: int, last: int) -> bytes:
        """Units [first, last) as bytes; words are joined by one space."""
        if not self.words:
            return self.raw[first:last]
        return b" ".join(self.raw[self.start[first] : self.end[last - 1]].split())


def anchors(scheme: Scheme, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: its hash, the first and last window, the document's row."""
    w, n = scheme.window, len(units.hash)
    if n < w:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    grams = shared.mix(shared.rolling(units.hash, scheme.gram))
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, reach = w - scheme.gram + 1, 1
    while reach * 2 <= span:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < span:
        key = np.minimum(key[: len(key) - (span - reach)], key[span - reach :])
    place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows that reach into the next document are none.
    row = np.repeat(np.arange(len(units.rows) - 1), np.diff(units.rows))[: len(place)]
    whole = np.arange(len(place)) + w <= units.rows[row + 1]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (place[1:] != place[:-1]) | ~whole[:-1] | (row[1:] != row[:-1])
    fresh &= whole
    first = np.flatnonzero(fresh)
    stop = np.flatnonzero(whole & np.append(fresh[1:] | ~whole[1:], True))
    # Least hashes crowd near 0: spread them again, so slices get equal shares.
    return shared.mix(grams[place[first]]), first, stop, row[first]


def packed(x: np.ndarray) -> bytes:
    return _CODEC.compress(x.tobytes(), asbytes=True)


def unpacked(blob: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(blob, n * np.dtype(kind).itemsize, asbytes=True), kind)


@shared.frugal
def thin(batches):
    """Step 0 in a task: each text once with its smallest id so far; repeats of that row as a number."""
    least: dict[bytes, int] = {}
    again: dict[bytes, list] = {}
    for batch in batches:
        keep = []
        for row, (key, doc) in enumerate(zip(batch["digest"].to_pylist(), batch["id_key"].to_pylist())):
            if doc < least.get(key, NO_ID + 1):
                least[key] = doc
                again.pop(key, None)
                keep.append(row)
            elif doc == least[key]:
                again.setdefault(key, [batch["bucket"][row].as_py(), batch["doc_id"][row].as_py(), 0])[2] += 1
        part = batch.take(pa.array(keep, pa.int32()))
        yield pa.RecordBatch.from_arrays([*(part[c] for c in _THIN.names[:-1]), pa.array(np.ones(len(keep), np.int64))], schema=_THIN)
    rows = [{"bucket": b, "digest": key, "doc_id": doc, "id_key": least[key], "text": None, "copies": n} for key, (b, doc, n) in again.items()]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _THIN)


def documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """Ids (NULL last), text bytes and offsets of a bucket's texts, in order of id, with their rows."""
    least: dict[bytes, list] = {}
    for row, (key, doc, has, n) in enumerate(zip(table["digest"].to_pylist(), table["id_key"].to_pylist(), table["text"].is_valid().to_pylist(), table["copies"].to_pylist())):
        known = least.get(key)
        if known is None or doc < known[0]:
            least[key] = [doc, row if has else -1, n]
        elif doc == known[0]:
            known[1] = row if has else known[1]
            known[2] += n
    chosen = sorted(least.items(), key=lambda x: (x[1][0], x[0]))
    table = table.take(pa.array([row for _, (_, row, _) in chosen], pa.int64()))
    table = table.set_column(table.schema.get_field_index("copies"), "copies", pa.array([n for _, (_, _, n) in chosen], pa.int64()))
    data, offsets = shared.byte_column(table["text"])
    return np.array([doc for _, (doc, _, _) in chosen], np.int64), data, offsets, table


def _blocks(scheme: Scheme, data: np.ndarray, offsets: np.ndarray):
    for a, b in shared.chunks(offsets, CHUNK):
        lo = offsets[a]
        yield a, b, Units(scheme, data[lo : offsets[b]], offsets[a : b + 1] - lo)


def sliced(keys: np.ndarray, slices: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The slices of ascending keys, and the range of keys of each."""
    at = (keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
    present, first = np.unique(at, return_index=True)
    return present.astype(np.int64), list(zip(first.tolist(), [*first[1:].tolist(), len(keys)]))


@shared.frugal
def _report(scheme: Scheme, slices: int, table: pa.Table) -> dict:
    """Step 1: the anchors of a bucket by slice, with the number of places of each."""
    ids, data, offsets, _ = documents(table)
    hashes, docs = [], []
    for a, _, units in _blocks(scheme, data, offsets):
        h, _, _, row = anchors(scheme, units)
        hashes.append(h)
        docs.append(row + a)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    if not scheme.words:
        # A match within a document doesn't count: one place per document.
        d = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h = h[keep]
    h, n = np.unique(h, return_counts=True)
    n = np.minimum(n, 65535).astype(np.uint16)
    # Kept to 48 bits, as differences: a false match only makes a candidate.
    present, ranges = sliced(h, slices)
    return {
        "slice": present.tolist(),
        "size": [y - x for x, y in ranges],
        "hashes": [packed(np.diff(h[x:y] >> np.uint64(16), prepend=np.uint64(0))) for x, y in ranges],
        "counts": [packed(n[x:y]) for x, y in ranges],
    }


@shared.frugal
def _shared(scheme: Scheme, table: pa.Table) -> dict:
    """Step 2: of one slice, the anchors that stand in two places, for each bucket that has them."""
    sizes, buckets = table["size"].to_pylist(), table["bucket"].to_pylist()
    h = np.concatenate([np.cumsum(unpacked(x, np.uint64, n), dtype=np.uint64) for x, n in zip(table["hashes"].to_pylist(), sizes)])
    n = np.concatenate([unpacked(x, np.uint16, n) for x, n in zip(table["counts"].to_pylist(), sizes)]).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    unique, back = np.unique(h, return_inverse=True)
    total = np.bincount(back, n, len(unique))[back]
    out = {"bucket": [], "sizes": [], "cold": [], "hot": []}
    common = total >= 2
    h, of, hot = h[common], of[common], total[common] > scheme.hot
    edges = np.searchsorted(of, np.arange(len(sizes) + 1))
    for k, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
        if y > x:
            cold, warm = h[x:y][~hot[x:y]], h[x:y][hot[x:y]]
            out["bucket"].append(buckets[k])
            out["sizes"].append([len(cold), len(warm)])
            out["cold"].append(packed(np.diff(cold, prepend=np.uint64(0))))
            out["hot"].append(packed(np.diff(warm, prepend=np.uint64(0))))
    return out


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


@dataclass
class Snippets:
    """The different snippets of a bucket in order of key and content, and every place they stand at."""

    keys: np.ndarray
    contents: list[bytes]
    owner: np.ndarray  # of each snippet the earliest place: id, unit in the document
    row: np.ndarray  # of each place: the text's row,
    at: np.ndarray  # the unit in it,
    number: np.ndarray  # and the snippet


def _snippets(scheme: Scheme, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, cold: np.ndarray, hot: np.ndarray) -> Snippets:
    """Cut out the windows of all shared anchors, those of cold ones together."""
    seen: dict[tuple[int, bytes], int] = {}
    rows, starts, numbers = [], [], []
    for a, _, units in _blocks(scheme, data, offsets):
        h, first, last, row = anchors(scheme, units)
        short = h >> np.uint64(16)
        is_cold, is_hot = _member(cold, short), _member(hot, short)
        parts = [(h[is_cold], first[is_cold], last[is_cold], row[is_cold])]
        if is_hot.any():
            size = last[is_hot] - first[is_hot] + 1
            place = np.repeat(first[is_hot] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            whole = shared.mix(shared.rolling(units.hash, scheme.window)[place])
            parts.append((whole, place, place, np.repeat(row[is_hot], size)))
        for key, x, y, r in parts:
            content = units.content
            numbers.append([seen.setdefault((k, content(i, j)), len(seen)) for k, i, j in zip(key.tolist(), x.tolist(), (y + scheme.window).tolist())])
            rows.append(r + a)
            starts.append(x - units.rows[r])
    found = sorted(seen)
    rank = np.empty(len(found), np.int64)
    rank[[seen[x] for x in found]] = np.arange(len(found))
    row, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, starts))
    number = rank[np.concatenate([np.array(x, np.int64) for x in numbers])] if numbers else np.zeros(0, np.int64)
    order = np.lexsort((at, ids[row], number))
    first = order[np.flatnonzero(np.diff(number[order], prepend=-1))]
    return Snippets(np.array([k for k, _ in found], np.uint64), [c for _, c in found], np.stack([ids[row[first]], at[first]], 1), row, at, number)


def _marks(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    out = ([np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)])
    for sizes, *blobs in zip(*(table[c].to_pylist() for c in ("sizes", "cold", "hot"))):
        if sizes:
            for part, blob, n in zip(out, blobs, sizes):
                part.append(np.cumsum(unpacked(blob, np.uint64, n), dtype=np.uint64))
    return tuple(np.sort(np.concatenate(x)) for x in out)


@shared.frugal
def _cut(scheme: Scheme, slices: int, docs: pa.Table, marks: pa.Table) -> dict:
    """Step 3: the different snippets of a bucket, by slice of their key."""
    ids, data, offsets, _ = documents(docs)
    found = _snippets(scheme, ids, data, offsets, *_marks(marks))
    sizes = np.array([len(x) for x in found.contents], np.int32)
    present, ranges = sliced(found.keys, slices)
    contents = [b"".join(found.contents[x:y]) for x, y in ranges]
    return {
        "slice": present.tolist(),
        "first": [x for x, _ in ranges],
        "size": [y - x for x, y in ranges],
        "bytes": [len(x) for x in contents],
        "keys": [packed(found.keys[x:y]) for x, y in ranges],
        "sizes": [packed(sizes[x:y]) for x, y in ranges],
        "contents": [_CODEC.compress(x, asbytes=True) for x in contents],
        "places": [packed(found.owner[x:y].T.copy()) for x, y in ranges],
    }


@shared.frugal
def _answers(matcher: Callable, window: int, table: pa.Table) -> dict:
    """Step 4: match the snippets of a slice; per bucket, the runs of windows with an earlier place elsewhere."""
    number: dict[tuple[int, bytes], int] = {}
    earliest: list[tuple[int, int]] = []
    uses = []  # (bucket, index in the bucket, snippet, place in the bucket)
    for bucket, base, n, size, *blobs in zip(*(table[c].to_pylist() for c in ("bucket", "first", "size", "bytes", "keys", "sizes", "contents", "places"))):
        keys, sizes = (unpacked(x, kind, n).tolist() for x, kind in zip(blobs, (np.uint64, np.int32)))
        contents = _CODEC.decompress(blobs[2], size, asbytes=True)
        docs, starts = unpacked(blobs[3], np.int64, 2 * n).reshape(2, n).tolist()
        end = 0
        for index, (key, size, doc, at) in enumerate(zip(keys, sizes, docs, starts), base):
            end += size
            n = number.setdefault((key, contents[end - size : end]), len(earliest))
            if n == len(earliest):
                earliest.append((doc, at))
            elif (doc, at) < earliest[n]:
                earliest[n] = (doc, at)
            uses.append((bucket, index, n, doc, at))
    keys, contents = [k for k, _ in number], [c for _, c in number]
    own = np.array(earliest, np.int64).reshape(-1, 2)
    # For each window in order of snippet and place: snippet, offset, class of equal windows.
    snippet, offset, kind = matcher(keys, contents, window)
    doc, at = own[snippet, 0], own[snippet, 1] + offset
    order = np.lexsort((at, doc, kind))
    ahead = np.ones(len(order), bool)
    ahead[1:] = kind[order][1:] != kind[order][:-1]
    lead = np.zeros(len(order), np.int64)
    lead[order] = order[np.flatnonzero(ahead)[np.cumsum(ahead) - 1]] if len(order) else 0
    doc, at = doc[lead], at[lead]
    # Runs: the next window of the snippet goes on at the next unit of the same document.
    fresh = np.ones(len(snippet), bool)
    fresh[1:] = (snippet[1:] != snippet[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(fresh)
    stop = np.append(begin[1:], len(snippet))
    runs = np.stack([offset[begin], offset[begin] + stop - begin, doc[begin], at[begin]], 1) if len(begin) else np.zeros((0, 4), np.int64)
    edge = np.searchsorted(snippet[begin], np.arange(len(earliest) + 1))
    back: dict[int, list] = {}
    runs, edge = runs.tolist(), edge.tolist()
    for bucket, index, n, doc, at in uses:
        for run in runs[edge[n] : edge[n + 1]]:
            if run[2] != doc or run[3] != at + run[0]:
                back.setdefault(bucket, []).append((index, *run))
    return {"bucket": list(back), "runs": [np.array(x, np.int64).tobytes() for x in back.values()]}


@shared.frugal
def _covered(scheme: Scheme, docs: pa.Table, marks: pa.Table):
    """Step 5: the texts of a bucket in order of id, and the maximal runs of units in repeated windows of each."""
    ids, data, offsets, docs = documents(docs)
    found = _snippets(scheme, ids, data, offsets, *_marks(marks))
    blobs = [np.frombuffer(x, np.int64).reshape(-1, 5) for x in marks["runs"].to_pylist() if x]
    runs = np.concatenate([np.zeros((0, 5), np.int64), *blobs])
    snippet, x, y, doc, start = runs[np.lexsort((runs[:, 1], runs[:, 0]))].T
    # Between the runs, and behind the last, a snippet's earliest place is the bucket's own.
    units = np.array([c.count(b" ") + 1 if scheme.words else len(c) for c in found.contents], np.int64)
    count = units - scheme.window + 1
    done = np.append(0, y[:-1]) * (np.diff(snippet, prepend=-1) == 0) if len(snippet) else y
    tail = np.zeros(len(count), np.int64)
    tail[snippet] = y  # runs are in order: the last one stays
    own = np.arange(len(count))
    of = np.concatenate([snippet, snippet, own])
    low, high = np.concatenate([x, done, tail]), np.concatenate([y, x, count])
    first = np.concatenate([doc, found.owner[snippet, 0], found.owner[:, 0]])
    at = np.concatenate([start, found.owner[snippet, 1] + done, found.owner[:, 1] + tail])
    part = np.flatnonzero(high > low)
    part = part[np.argsort(of[part], kind="stable")]
    edge = np.searchsorted(of[part], np.arange(len(count) + 1))
    # Every place of a snippet meets each of its parts.
    size = np.diff(edge)[found.number]
    ends = np.cumsum(size)
    each = part[np.repeat(edge[found.number] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
    row, here = np.repeat(found.row, size), np.repeat(found.at, size)
    again = first[each] < ids[row]
    if scheme.words:
        again |= (first[each] == ids[row]) & (at[each] < here + low[each])
    # Mark units by differences, over all texts in a row.
    rows = Units(scheme, data, offsets).rows if scheme.words else offsets
    begin = (rows[row] + here + low[each])[again]
    stop = (rows[row] + here + high[each] - 1 + scheme.window)[again]
    total = int(rows[-1])
    depth = np.cumsum(np.bincount(begin, minlength=total + 1)[: total + 1] - np.bincount(stop, minlength=total + 1)[: total + 1])
    inside = depth[:total] > 0
    starts, stops = inside.copy(), inside.copy()
    head, last = rows[:-1][np.diff(rows) > 0], rows[1:][np.diff(rows) > 0] - 1
    starts[1:] &= ~inside[:-1]
    starts[head] = inside[head]
    stops[:-1] &= ~inside[1:]
    stops[last] = inside[last]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    edge = np.searchsorted(starts, rows)
    spans = {r: list(zip((starts[i:j] - rows[r]).tolist(), (stops[i:j] - rows[r]).tolist())) for r, (i, j) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if j > i}
    return docs, data, offsets, spans


def repeated_spans(docs: DataFrame, scheme: Scheme, matcher: Callable, finish: Callable, copies: Callable, result: str) -> DataFrame:
    """Find repeated windows and hand every document to ``finish``, exact copies to ``copies``.

    ``docs`` has doc_id and text. ``matcher(keys, contents, window)`` returns arrays
    (snippet, offset, class) of all windows of the snippets, in that order, where
    windows of different snippets under one key have one class exactly if their units are equal.
    ``finish(docs table, data, offsets, spans by row)`` returns the columns of ``result``.
    ``copies`` gets rows whose text has a row of smaller id, with ``units`` (their number)
    and ``short`` (the text if it has no window), and returns the same columns.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id_key"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // scheme.bucket_bytes))
    slices = 2 * buckets
    # Few bytes are much work here: tasks by number, not by what Spark makes of their size.
    tasks = min(buckets, MOST_TASKS)
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")
    dealt = docs.select(bucket, "digest", "doc_id", "id_key", "text").mapInArrow(thin, THIN).repartition(tasks, "bucket")

    def with_bucket(key, columns: dict, schema: pa.Schema) -> pa.Table:
        columns["bucket"] = [key[0].as_py()] * len(columns["slice"])
        return pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema})

    reported = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("size", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
    known = dealt.groupBy("bucket").applyInArrow(lambda key, t: with_bucket(key, _report(scheme, slices, t), reported), "slice long, bucket int, size long, hashes binary, counts binary")
    marked = pa.schema([("bucket", pa.int32()), ("sizes", pa.list_(pa.int64())), ("cold", pa.binary()), ("hot", pa.binary())])
    marks = known.repartition(tasks, "slice").groupBy("slice").applyInArrow(lambda t: pa.table(_shared(scheme, t), marked), "bucket int, sizes array<long>, cold binary, hot binary")
    numbers, blobs = ("slice", "first", "size", "bytes"), ("keys", "sizes", "contents", "places")
    pieces = pa.schema([("bucket", pa.int32()), *((c, pa.int64()) for c in numbers), *((c, pa.binary()) for c in blobs)])
    cuts = (
        dealt.groupBy("bucket")
        .cogroup(marks.groupBy("bucket"))
        .applyInArrow(lambda key, t, m: with_bucket(key, _cut(scheme, slices, t, m), pieces), "bucket int, slice long, first long, size long, bytes long, keys binary, sizes binary, contents binary, places binary")
    )
    answered = pa.schema([("bucket", pa.int32()), ("runs", pa.binary())])
    answers = cuts.repartition(2 * tasks, "slice").groupBy("slice").applyInArrow(lambda t: pa.table(_answers(matcher, scheme.window, t), answered), "bucket int, runs binary")
    notes = marks.withColumn("runs", F.lit(None).cast("binary")).unionByName(answers, allowMissingColumns=True)

    def put(t: pa.Table, m: pa.Table) -> pa.Table:
        rows, data, offsets, spans = _covered(scheme, t, m)
        done = finish(rows, data, offsets, spans)
        again = rows["copies"].to_numpy()
        return done if (again == 1).all() else done.take(pa.array(np.repeat(np.arange(len(again)), again)))

    firsts = dealt.groupBy("bucket").cogroup(notes.groupBy("bucket")).applyInArrow(put, result)
    units = F.regexp_count("text", F.lit(shared.WORD_PATTERN)) if scheme.words else F.octet_length("text")
    rows = docs.select("doc_id", "id_key", "digest", units.cast("long").alias("units"), F.when(units < scheme.window, F.col("text")).alias("short"))
    least = rows.groupBy("digest").agg(F.min("id_key").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return firsts.unionByName(copies(rows.join(least, "digest").where("id_key > least")))
