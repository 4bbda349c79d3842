"""Text quality by a byte-level convolutional network, in numpy.

Bytes are embedded, a bank of learned filters slides over overlapping chunks that
together cover the whole text, each filter is max-pooled per chunk, and the mean,
largest and smallest chunk values are combined by one hidden layer into a
probability. The network is fitted on the driver on a bounded sample; scoring is
one pass over the documents with the weights in the task's closure.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnscore.llm.shared import byte_column, frugal, text_rows

CHUNK, STEP = 512, 448
KERNEL, STRIDE = 8, 4
PAD = 256
BLOCK = 256


@dataclass(frozen=True)
class Training:
    """``sample`` labelled texts per class at most, each of ``longest`` bytes at most, bound what the driver holds."""

    sample: int = 2000
    longest: int = 65_536
    steps: int = 700
    batch: int = 32
    rate: float = 4e-3
    embed: int = 8
    filters: int = 32
    hidden: int = 32
    seed: int = 7


def chunk_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every chunk, and the offsets of the rows among the chunks (at least one each)."""
    size = np.diff(offsets)
    count = 1 + np.maximum(0, -(-(size - CHUNK) // STEP))
    ends = np.cumsum(count)
    inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
    return np.repeat(offsets[:-1], count) + inner * STEP, np.append(0, ends)


def chunk_bytes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Chunks as rows of byte numbers, padded behind the end of their text."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < stops[:, None]
    out = np.full(at.shape, PAD, np.int64)
    out[inside] = data[at[inside]]
    return out


@dataclass
class Network:
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    prior: float = 0.0

    @classmethod
    def fresh(cls, t: Training) -> "Network":
        rng = np.random.default_rng(t.seed)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        embed = normal(PAD + 1, t.embed, scale=0.5)
        embed[PAD] = 0
        return cls(
            {
                "embed": embed,
                "filter": normal(KERNEL * t.embed, t.filters, scale=(KERNEL * t.embed) ** -0.5),
                "shift": np.zeros(t.filters, np.float32),
                "mix": normal(3 * t.filters, t.hidden, scale=(3 * t.filters) ** -0.5),
                "bias": np.zeros(t.hidden, np.float32),
                "out": normal(t.hidden, 1, scale=t.hidden**-0.5),
                "last": np.zeros(1, np.float32),
            }
        )

    def _windows(self, rows: np.ndarray) -> np.ndarray:
        x = self.weights["embed"][rows]
        view = np.lib.stride_tricks.sliding_window_view(x.reshape(len(rows), -1), KERNEL * x.shape[2], axis=1)
        return view[:, :: STRIDE * x.shape[2]]

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per chunk and filter the largest response, where it is, and the windows."""
        windows = np.ascontiguousarray(self._windows(rows))
        z = windows.reshape(-1, windows.shape[2]) @ self.weights["filter"]
        z = z.reshape(len(rows), -1, z.shape[1])
        at = z.argmax(axis=1)
        return np.take_along_axis(z, at[:, None], 1)[:, 0] + self.weights["shift"], at, windows

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean, largest and smallest chunk value of every filter, for every text."""
        starts, rows = chunk_starts(offsets)
        stops = np.repeat(offsets[1:], np.diff(rows))
        parts = []
        for x in range(0, len(starts), BLOCK):
            windows = np.ascontiguousarray(self._windows(chunk_bytes(data, starts[x : x + BLOCK], stops[x : x + BLOCK])))
            z = windows.reshape(-1, windows.shape[2]) @ self.weights["filter"]
            parts.append(z.reshape(len(windows), -1, z.shape[1]).max(axis=1) + self.weights["shift"])
        value = np.maximum(np.concatenate(parts), 0)
        head = rows[:-1]
        mean = np.add.reduceat(value, head, dtype=np.float64) / np.diff(rows)[:, None]
        return np.concatenate([mean, np.maximum.reduceat(value, head), np.minimum.reduceat(value, head)], 1)

    def probability(self, features: np.ndarray) -> np.ndarray:
        w = self.weights
        hidden = np.maximum(features @ w["mix"] + w["bias"], 0)
        return 1 / (1 + np.exp(-np.clip((hidden @ w["out"])[:, 0] + w["last"][0] + self.prior, -60, 60)))

    def gradient(self, data: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        starts, rows = chunk_starts(offsets)
        chunks = chunk_bytes(data, starts, np.repeat(offsets[1:], np.diff(rows)))
        raw, at, windows = self.pooled(chunks)
        value, head, count = np.maximum(raw, 0), rows[:-1], np.diff(rows)
        largest, smallest = np.maximum.reduceat(value, head), np.minimum.reduceat(value, head)
        features = np.concatenate([np.add.reduceat(value, head) / count[:, None], largest, smallest], 1)
        pre = features @ w["mix"] + w["bias"]
        hidden = np.maximum(pre, 0)
        p = 1 / (1 + np.exp(-np.clip((hidden @ w["out"])[:, 0] + w["last"][0], -60, 60)))
        d = ((p - label) / len(label)).astype(np.float32)
        back = (d[:, None] * w["out"][:, 0]) * (pre > 0)
        f = back @ w["mix"].T
        n = w["shift"].size
        of = np.repeat(np.arange(len(label)), count)
        dv = f[of, :n] / count[of, None]
        for part, extreme in ((f[:, n : 2 * n], largest), (f[:, 2 * n :], smallest)):
            hit = value == extreme[of]
            shared = np.add.reduceat(hit, head, dtype=np.float32)
            dv = dv + hit * (part / shared)[of]
        dv = (dv * (raw > 0)).astype(np.float32)
        picked = np.take_along_axis(windows, at[:, :, None], 1)  # chunk, filter, window
        dw = np.einsum("cf,cfk->kf", dv, picked)
        dx = (dv[:, :, None] * w["filter"].T[None]).reshape(len(chunks), n, KERNEL, -1)
        place = at[:, :, None] * STRIDE + np.arange(KERNEL)
        byte = np.take_along_axis(chunks, place.reshape(len(chunks), -1), 1)
        de = np.zeros_like(w["embed"])
        np.add.at(de, byte.reshape(-1), dx.reshape(-1, dx.shape[3]))
        de[PAD] = 0
        return {"embed": de, "filter": dw, "shift": dv.sum(0), "mix": features.T @ back, "bias": back.sum(0), "out": (hidden.T @ d)[:, None], "last": d.sum(keepdims=True)}


def train(texts: list[bytes], labels: np.ndarray, share: float, t: Training = Training()) -> Network:
    """Adam on batches with as many texts of either class; ``share`` is label 1's real share."""
    net = Network.fresh(t)
    rng = np.random.default_rng(t.seed)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        # Nothing to tell apart: the share is all that is known.
        net.weights["out"][:] = 0
        net.prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    half = t.batch // 2
    for step in range(1, t.steps + 1):
        pick = np.concatenate([rng.choice(good, half), rng.choice(bad, half)])
        rows = [texts[i] for i in pick]
        offsets = np.append(0, np.cumsum([len(x) for x in rows]))
        grads = net.gradient(np.frombuffer(b"".join(rows), np.uint8), offsets, labels[pick].astype(np.float32))
        rate = t.rate * min(1, 2 * (1 - step / (t.steps + 1)))
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    net.prior = float(np.log(share / (1 - share)))
    return net


def held_out(doc_id: Column) -> Column:
    """Documents never learnt from: crc32 of the id as text leaves 1 modulo 3. False for NULL ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, t: Training = Training(), label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Learn ``label`` (0 or 1) from labelled documents that are not held out.

    Only ids meet the labels; texts are fetched for the sample alone: per class the
    ``t.sample`` ids of smallest hash whose texts have at most ``t.longest`` bytes. The
    class shares come from all labelled documents. A document labelled twice counts
    as the lower label; NULL labels are no labels. Without any label the score is 0.5.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label")).where(~held_out(F.col("doc_id")))
    texts = text_rows(docs, id_col, text_col)
    ids = texts.select("doc_id", F.octet_length("text").alias("size")).groupBy("doc_id").agg(F.max("size").alias("size"))
    marked = marks.join(ids, "doc_id")
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], np.zeros(0), 0.5, t)
    usable = marked.where(F.coalesce("size", F.lit(0)) <= t.longest)
    picked = [usable.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(t.sample) for k in (0, 1)]
    # At most 2 * t.sample rows of two numbers: small enough to send everywhere.
    chosen = F.broadcast(picked[0].unionByName(picked[1]).select("doc_id", "label"))
    rows = texts.join(chosen, "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")).distinct().collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    share = counts.get(1, 0) / sum(counts.values())
    return train([r["text"].encode() for r in rows], np.array([r["label"] for r in rows]), min(max(share, 1e-3), 1 - 1e-3), t)


def _scores(net: Network, column) -> np.ndarray:
    data, offsets = byte_column(column)
    if len(offsets) == 1:
        return np.zeros(0)
    return net.probability(net.features(data, offsets))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (likelihood of label 1) of every row, from its bytes alone.

    The whole text counts whatever its length; an empty or NULL text is one padded
    chunk and has a score like any other.
    """

    @frugal
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(_scores(net, batch["text"]), pa.float64())], ["doc_id", "score"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, net: Network, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, with all their columns."""

    @frugal
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array(_scores(net, column) >= least))

    return docs.mapInArrow(run, docs.schema)
