"""Periodic runs of words: stretches that repeat a period four times or more.

A run of period q is a stretch of words that are equal q words apart. On the
diagonal of lag q it is a piece of equal words of at least three periods (five words
for q = 1), so it holds two equal k-grams q words apart whenever k is at most that.
Seeds are taken level by level: for lags from 2**t to below 2**(t + 1) the k-grams of
the smallest piece a run of these lags can leave, k = 3 * 2**t (5 at the first level).
Such a k-gram is no shorter than the period, so inside a run of smallest period q it
comes again after q words and not before: only pairs of neighbouring occurrences are
enumerated, at most one per word and level, however often a k-gram occurs.

A seed is extended along its diagonal to both sides on exact word numbers. Per lag a
table keeps how far the diagonal has been covered; seeds before that are skipped, so
every piece is walked once. k-grams are numbered exactly, by pairing the numbers of
shorter ones; words whose gram occurs once in its document leave all later levels.

A document's words are one task's work; documents are independent of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from txnscore.llm.shared import BLANK, byte_column, chunks, frugal, text_rows, words_of

LEAST, TIMES = 6, 4
CHUNK = 2 << 20


def word_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Equal numbers for equal words, and the different words by number; words are compared whole."""
    size = end - start
    keep = np.zeros(len(data) + 1, np.int8)
    keep[start] += 1
    keep[end] -= 1
    inside = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    offsets = np.append(0, np.cumsum(size))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _paired(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of pairs, and whether each pair occurs more than once."""
    number, _ = pd.factorize(left * (right.max() + 1) + right) if len(left) else (np.zeros(0, np.int64), None)
    return number, np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)


class _Grams:
    """The grams of one length that occur more than once: their places, ascending, and numbers."""

    def __init__(self, at: np.ndarray, number: np.ndarray, size: int, words: int):
        self.at, self.number, self.size, self.words = at, number, size, words

    def __len__(self):
        return len(self.at)

    def then(self, other: "_Grams") -> "_Grams":
        """Grams of this length followed by those of another one."""
        spot = np.full(self.words + 1, -1, np.int64)
        spot[other.at] = other.number
        follow = spot[np.minimum(self.at + self.size, self.words)]
        known = follow >= 0
        number, again = _paired(self.number[known], follow[known])
        return _Grams(self.at[known][again], number[again], self.size + other.size, self.words)

    def seeds(self, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and lag of neighbouring occurrences with a lag in [least, most), by lag, then place."""
        order = np.argsort(self.number, kind="stable")
        at, number = self.at[order], self.number[order]
        lag = at[1:] - at[:-1]
        near = (number[1:] == number[:-1]) & (lag >= least) & (lag < most)
        place, lag = at[:-1][near], lag[near]
        order = np.lexsort((place, lag))
        return place[order], lag[order]


def _equal_ahead(words: np.ndarray, x: int, y: int) -> int:
    """How many words from ``x`` on equal those from ``y`` on (y > x; a stop word ends the last text)."""
    n, step = 0, 32
    while True:
        a, b = words[x + n : x + n + step], words[y + n : y + n + step]
        wrong = np.flatnonzero(a[: len(b)] != b)
        if len(wrong):
            return n + int(wrong[0])
        n += len(b)
        if len(b) < step:
            return n
        step = min(2 * step, 1 << 16)


def _equal_behind(words: np.ndarray, x: int, y: int) -> int:
    """How many words before ``x`` equal those before ``y``."""
    n, step = 0, 32
    while n < x:
        step = min(step, x - n)
        wrong = np.flatnonzero(words[x - n - step : x - n] != words[y - n - step : y - n])
        if len(wrong):
            return n + step - 1 - int(wrong[-1])
        n += step
        step = min(2 * step, 1 << 16)
    return n


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run, by start, then period.

    Equal words have equal numbers. Where several texts follow each other, no word of
    one may have a number of another, and a number of its own must stand behind each.
    """
    n, found = len(words), []
    number, again = _paired(words, np.zeros(n, np.int64))
    power = _Grams(np.flatnonzero(again), number[again], 1, n)
    first = power
    lag = 1
    while len(power):
        # ``power`` has grams of ``lag`` words, here joined to those of the level.
        double = power.then(power)
        if not len(double):
            break
        grams = double.then(double).then(first) if lag == 1 else double.then(power)
        place, lags = grams.seeds(lag, 2 * lag)
        begin = np.flatnonzero(np.append(True, lags[1:] != lags[:-1])) if len(lags) else []
        for a, b in zip(begin, np.append(begin[1:], len(lags)) if len(lags) else []):
            q, covered, k = int(lags[a]), 0, int(a)
            while k < b:
                i = int(place[k])
                start = i - _equal_behind(words, i, i + q)
                covered = i + _equal_ahead(words, i, i + q)
                if covered - start + q >= max(LEAST, TIMES * q):
                    found.append((start, covered - start + q, q))
                k = int(a + np.searchsorted(place[a:b], covered))
        power, lag = double, 2 * lag
    return sorted(found, key=lambda r: (r[0], r[2]))


def _gathered(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Words, runs and remaining text of every row."""
    start, end, rows = words_of(data, offsets, BLANK)
    own, names = word_numbers(data, start, end)
    count, kinds = np.diff(rows), len(names)
    # Every text has numbers of its own and one more behind its last word.
    of = np.repeat(np.arange(len(count)), count)
    words = np.full(len(own) + len(count), -1, np.int64)
    words[np.arange(len(own)) + of] = own + of * kinds
    stops = rows[1:] + np.arange(len(count))
    words[stops] = kinds * len(count) + np.arange(len(count))
    heads = rows[:-1] + np.arange(len(count))
    found: list[list[tuple[int, int, int]]] = [[] for _ in count]
    for a, size, q in runs_of(words):
        row = int(np.searchsorted(heads, a, "right")) - 1
        found[row].append((a - int(heads[row]), size, q))
    # A word keeps its bytes and the blank behind it, if there is one.
    flat = np.where(BLANK[data], np.uint8(0x20), data)
    for row, runs in enumerate(found):
        first, last = int(rows[row]), int(rows[row + 1])
        gone = np.zeros(last - first + 1, np.int64)
        for a, size, q in runs:
            gone[a + q] += 1
            gone[a + size] -= 1
        stay = np.cumsum(gone[:-1]) == 0
        begin, stop = start[first:last][stay], end[first:last][stay]
        base, limit = int(offsets[row]), int(offsets[row + 1])
        mark = np.zeros(limit - base + 2, np.int8)
        mark[begin - base] += 1
        mark[stop - base + 1] -= 1
        kept = flat[base:limit][np.cumsum(mark[: limit - base], dtype=np.int8) > 0]
        yield last - first, runs, kept.tobytes().removesuffix(b" ")


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])
_TYPES = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", before: Callable[[int | None, bytes], bytes] | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` and ``collapsed`` of every row, whatever its length.

    A run is a stretch of words whose smallest period is q, at least max(6, 4 * q) words
    long, that neither neighbour extends; ``runs`` has (start, length, period) by start,
    then period, counted in words from 0. ``collapsed`` is the text without the words that
    any run holds after its first period, the rest joined by one space. NULL, empty and
    blank texts have no words, no runs and an empty rest. Rows are independent: repeated
    rows and NULL ids need no rule. ``before`` may rewrite the bytes of a text first.
    """

    @frugal
    def run(batches):
        for batch in batches:
            data, offsets = byte_column(batch["text"])
            ids = batch["doc_id"].to_pylist()
            if before is not None:
                given = data.tobytes()
                texts = [before(ids[k], given[offsets[k] : offsets[k + 1]]) for k in range(len(ids))]
                data = np.frombuffer(b"".join(texts), np.uint8)
                offsets = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
            for a, b in chunks(offsets, CHUNK):
                part = list(_gathered(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                runs = [[{"start": s, "length": m, "period": q} for s, m, q in r] for _, r, _ in part]
                rest = pa.array([k for _, _, k in part], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array([n for n, _, _ in part], pa.int64()), pa.array(runs, _RUNS), rest], schema=_OUT)

    return text_rows(docs, id_col, text_col).mapInArrow(run, _TYPES)
