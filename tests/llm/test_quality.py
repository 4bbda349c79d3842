import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from txnscore.llm import quality

SMALL = quality.Training(steps=120, batch=16, filters=8, hidden=8)


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    good = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 300))) for _ in range(n)]
    bad = [" ".join(rng.choice(words).upper() + "!!" for _ in range(rng.randint(5, 300))) for _ in range(n)]
    return good, bad


def test_gradient_is_the_slope():
    net = quality.Network.fresh(quality.Training(filters=4, hidden=3))
    for k in net.weights:
        net.weights[k] = net.weights[k].astype(np.float64)
    net.weights["shift"] += 0.2  # away from the corner of an empty text's zeros
    rows = [b"some words of a text" * 40, b"SHORT", b""]
    data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.append(0, np.cumsum([len(x) for x in rows]))
    label = np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.probability(net.features(data, offsets))
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()

    grads = net.gradient(data, offsets, label)
    rng = np.random.default_rng(0)
    for name in ("filter", "shift", "mix", "bias", "out", "last"):
        flat, slope = net.weights[name].reshape(-1), grads[name].reshape(-1)
        for k in rng.integers(0, flat.size, 4):
            before = flat[k]
            flat[k] = before + 1e-5
            up = loss()
            flat[k] = before - 1e-5
            down = loss()
            flat[k] = before
            assert abs((up - down) / 2e-5 - slope[k]) < 1e-3


def test_learns_and_covers_whole_texts():
    good, bad = texts(60)
    labels = np.array([1] * 60 + [0] * 60)
    net = quality.train([x.encode() for x in good + bad], labels, 0.5, SMALL)
    fresh_good, fresh_bad = texts(40, 2)
    assert (quality._scores(net, pa.array(fresh_good)) >= 0.5).mean() > 0.9
    assert (quality._scores(net, pa.array(fresh_bad)) < 0.5).mean() > 0.9
    # Whatever stands far behind the beginning counts, too.
    long = " ".join(fresh_good)
    changed = long + " " + " ".join(fresh_bad)
    one, two = quality._scores(net, pa.array([long, changed]))
    assert one != two


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        starts, rows = quality.chunk_starts(np.array([0, n]))
        seen = np.zeros(n, bool)
        for s in starts:
            seen[s : s + quality.CHUNK] = True
        assert seen.all() and rows[-1] == len(starts) >= 1


def test_rows_and_held_out(spark, docs):
    good, bad = texts(40)
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(None, "x"), (200, None), (201, ""), (3, good[3])]
    frame = docs(rows)
    marks = [(i, 1 if i < 40 else 0, 0) for i in range(80)] + [(5, 1, 0), (6, None, 1), (None, 1, 0), (999, 0, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    net = quality.fit(frame, labels, SMALL)
    got = quality.score(frame, net).withColumn("out", quality.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    kept = quality.keep_good(frame, net)
    assert kept.columns == frame.columns
    assert kept.count() == sum(r.score >= 0.5 for r in got)
    # Labels of held-out documents change nothing.
    held = [(i, 1 - q if q is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in marks]
    other = quality.fit(frame, spark.createDataFrame(held, "doc_id long, quality int, toxic int"), SMALL)
    assert all((net.weights[k] == other.weights[k]).all() for k in net.weights)


def test_empty_tables(spark, docs):
    frame = docs([(1, "a")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = quality.fit(frame, none, SMALL)
    assert quality.score(frame, net).first().score == 0.5
    assert quality.score(frame.limit(0), net).collect() == []
