"""What several llm operators need: texts as arrays, hashes of bytes and words, components."""

from __future__ import annotations

import ctypes
import functools
import inspect
import os
import zipfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnscore.session import materialize

# Characters that separate words: [\x20\x09-\x0D].
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

ARROW_BYTES = "4m"

# An odd base, its inverse modulo 2**64, and one random value for each byte.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
BYTE_VALUE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64)


def byte_column(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow text column as one array of UTF-8 bytes and the n + 1 offsets of its rows; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int):
    """Row ranges (first, last) whose bytes come to about ``size``; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LIBC = ctypes.CDLL(None)
LOW_BITS = 12


@functools.lru_cache(maxsize=8)
def _low_powers(base: int) -> np.ndarray:
    known = np.full(1 << LOW_BITS, base, np.uint64)
    known[0] = 1
    return np.cumprod(known, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers; only the lowest of them are kept, so that idle workers stay small."""
    low = _low_powers(base)
    high = np.full(max(1, -(-n >> LOW_BITS)), pow(base, 1 << LOW_BITS, 1 << 64), np.uint64)
    high[0] = 1
    return (np.cumprod(high, dtype=np.uint64)[:, None] * low).reshape(-1)[:n]


def words_of(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in ``data``, and the offsets of the rows among the words."""
    n = len(data)
    blank = gap[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    ends = np.zeros(n, bool)
    ends[:-1] = ~blank[:-1] & blank[1:]
    if n:
        ends[-1] = not blank[-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner] |= ~blank[inner]
    ends[inner - 1] |= ~blank[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, whatever its place."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, n), dtype=np.uint64, out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(UNBASE, n + 1)[start] + (end - start).astype(np.uint64))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """The polynomial hash of every ``k`` values in a row (n - k + 1 of them), by doubling."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    part, length, done, out = values, 1, 0, None
    while True:
        if k & length:
            if out is None:
                out, done = part, length
            else:
                shift = np.uint64(pow(BASE, length, 1 << 64))
                m = len(out) - length
                out = out[:m] * shift + part[done : done + m]
                done += length
        if length * 2 > k:
            return out[: len(values) - k + 1]
        shift = np.uint64(pow(BASE, length, 1 << 64))
        part = part[:-length] * shift + part[length:]
        length *= 2


def release() -> None:
    """Give memory that is free back to the system: workers live on after a task, beside those of other steps."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def frugal(run: Callable) -> Callable:
    """A function of batches or of a group's tables that releases memory when it is done."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def batches(*args):
            yield from run(*args)
            release()

        return batches

    @functools.wraps(run)
    def group(*args):
        out = run(*args)
        release()
        return out

    return group


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under its own names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def components(edges: DataFrame, tag: str) -> DataFrame:
    """``(node, root)``: the smallest node reachable over ``edges`` (a, b), for every node that isn't its own root.

    Alternating star steps: each node hands its larger, then its smaller neighbours
    to its smallest one, until nothing changes (about log n rounds). Every step is
    an aggregation and an equi-join, and each round is a written table, so a node
    with very many neighbours is only ever a partially aggregated key.
    """
    spark = edges.sparkSession
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-edges")
    before = None
    while True:
        # Large star: neighbours above a node go to the smallest of its neighbourhood.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), "m"), F.struct(F.col("b").alias("x"), "m"))).alias("e"))
        small = small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        now = materialize(small, f"{tag}-stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return spark.createDataFrame([], "node long, root long") if not state[0] else now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def ship(spark: SparkSession) -> None:
    """Give the workers this package where they cannot import it from their own path, and
    batches of a size that several workers of a small executor can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_txnscore_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(sc._temp_dir, "txnscore.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._txnscore_shipped = True
