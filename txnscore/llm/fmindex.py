"""Removal of repeated word sequences with compressed FM-indexes.

Each shard (the snippets of a slice of anchors, see ``windows``) is indexed once:
the Burrows-Wheeler transform of its words in a wavelet matrix of packed bits with
block counts. The windows of the shard's documents are then streamed against it by
backward search, many at a time: every step narrows the interval of suffixes that
start with the words read so far, and the number of steps an interval survives is
the match length of the place. Places that reach the threshold are reported with
their interval; those with one interval hold the same words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnscore.llm.shared import WORD_PATTERN, text_rows
from txnscore.llm.windows import Scheme, repeated_spans

WINDOW = 20
STREAM = 1 << 17


class Bits:
    """A bit vector in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.pad(bits, (0, 64 - len(bits) % 64)), bitorder="little")
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones[:-1], dtype=np.int64)]).astype(np.uint32)
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)


class WaveletMatrix:
    """Rank of any symbol in a sequence, one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels = []
        for shift in range(width - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bits)))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        # Where the run of each symbol begins below the last level.
        self.first = np.zeros(1 << width, np.int64)
        begin = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        self.first[symbols[begin]] = begin

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences before ``low`` and before ``high`` of symbols that occur."""
        for shift, bits in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(high)
            low = np.where(one, bits.zeros + a, low - a)
            high = np.where(one, bits.zeros + b, high - b)
        return low - self.first[symbol], high - self.first[symbol]


class FMIndex:
    """The index of a sequence of symbols (0 separates texts), for patterns of up to ``depth`` symbols."""

    def __init__(self, symbols: np.ndarray, depth: int):
        rank, reach = symbols.astype(np.int64), 1
        while True:
            # Doubling: suffixes in order of their first 2 * reach symbols. Separators end the comparison.
            ahead = np.zeros(len(rank), np.int64)
            ahead[:-reach] = rank[reach:]
            ahead[symbols == 0] = 0
            order = np.argsort((rank << 32) | ahead, kind="stable")
            pair = (rank[order] << 32) | ahead[order]
            fresh = np.append(False, pair[1:] != pair[:-1])
            # Rank 0 stays with suffixes that start at a separator.
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(fresh)
            reach *= 2
            if reach >= depth:
                break
        before = symbols[order - 1]
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=int(symbols.max()) + 1))])
        self.tree = WaveletMatrix(before, max(1, int(symbols.max()).bit_length()))
        self.size = len(symbols)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of patterns that have one more symbol in front."""
        a, b = self.tree.ranks(symbol, low, high)
        return self.counts[symbol] + a, self.counts[symbol] + b

    def lengths(self, symbols: np.ndarray, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """How many symbols before each end are matched, up to ``limit``, and where their interval begins."""
        length, low, high = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        live = np.arange(len(ends))
        for step in range(1, limit + 1):
            at = ends[live] - step
            live = live[at >= 0]
            a, b = self.extend(symbols[ends[live] - step], low[live], high[live])
            found = b > a
            live = live[found]
            low[live], high[live], length[live] = a[found], b[found], step
        return length, low


def match(keys: list[int], contents: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matcher for ``windows.repeated_spans``: one index over all snippets of the slice."""
    number: dict[bytes, int] = {}
    flat: list[int] = []
    sizes = np.zeros(len(contents), np.int64)
    for i, content in enumerate(contents):
        words = content.split(b" ")
        sizes[i] = len(words)
        flat += [number.setdefault(x, len(number) + 1) for x in words]
        flat.append(0)
    if not flat:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    symbols = np.array(flat, np.int64)
    del flat, number
    index = FMIndex(symbols, window)
    at = np.cumsum(sizes + 1) - sizes - 1
    count = sizes - window + 1
    ends = np.cumsum(count)
    offset = np.arange(ends[-1]) - np.repeat(ends - count, count)
    stop = np.repeat(at, count) + offset + window
    kind = np.empty(len(stop), np.int64)
    for x in range(0, len(stop), STREAM):
        length, low = index.lengths(symbols, stop[x : x + STREAM], window)
        if (length < window).any():
            raise AssertionError("a shard's own window was not found in its index")
        kind[x : x + STREAM] = low
    return np.repeat(np.arange(len(contents)), count), offset, kind


RESULT = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, kept_text string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_text", pa.string())])


def _finish(docs: pa.Table, data: np.ndarray, offsets: np.ndarray, spans: dict[int, list]) -> pa.Table:
    counts, kept, cut = [], [], []
    for row, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        words = data[x:y].tobytes().split()
        at, parts = 0, []
        for a, b in spans.get(row, ()):
            parts += words[at:a]
            at = b
        counts.append(len(words))
        kept.append(b" ".join(parts + words[at:]))
        cut.append([{"start": a, "stop": b} for a, b in spans.get(row, ())])
    columns = [docs["doc_id"].combine_chunks(), pa.array(counts, pa.int64()), pa.array(cut, _ARROW.field("spans").type), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.table(columns, schema=_ARROW)


def _copies(window: int):
    def copies(rows: DataFrame) -> DataFrame:
        span = F.when(F.col("units") >= window, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("units").alias("stop")))).otherwise(F.array())
        words = F.regexp_extract_all(F.coalesce(F.col("short"), F.lit("")), F.lit(WORD_PATTERN), F.lit(0))
        return rows.select("doc_id", F.col("units").alias("n_words"), span.cast("array<struct<start:long,stop:long>>").alias("spans"), F.array_join(words, " ").alias("kept_text"))

    return copies


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = 6) -> DataFrame:
    """Cut every word covered by a ``window``-word sequence that also starts earlier.

    Earlier is a smaller id, or the same id and an earlier word. Returns doc_id, n_words,
    spans (word ranges cut, maximal, in order) and kept_text (the other words joined by
    one space). Words are separated by the characters of ``shared.BLANK`` only. NULL
    texts have no words; NULL ids count as the largest id; rows with equal ids and texts
    stand at the same places, so neither is earlier. Other columns are not read.
    """
    scheme = Scheme(window=window, gram=gram, words=True)
    return repeated_spans(text_rows(docs, id_col, text_col), scheme, match, _finish, _copies(window), RESULT)
