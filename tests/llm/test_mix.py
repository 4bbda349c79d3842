import itertools
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from txnscore.llm import mix


def best(sizes, counts, budget):
    sums = {0}
    for s, c in zip(sizes, counts):
        sums = {x + s * k for x in sums for k in range(c + 1) if x + s * k <= budget}
    return max(sums)


def test_fill_is_as_near_as_stock_allows():
    rng = random.Random(1)
    for _ in range(300):
        sizes = np.array(sorted(rng.sample(range(0, 40), rng.randint(1, 6))))
        counts = np.array([rng.randint(1, 4) for _ in sizes])
        budget = rng.randint(0, int((sizes * counts).sum()) + 5)
        taken = mix.fill(sizes, counts, budget)
        assert (0 <= taken).all() and (taken <= counts).all()
        got = int((sizes * taken).sum())
        # Sizes without a share of their own are fitted exactly within a few large documents.
        assert got <= budget
        assert budget - got <= max(budget - best(sizes.tolist(), counts.tolist(), budget), int(sizes.max()))


def test_fill_is_exact_with_ones_in_stock():
    rng = random.Random(2)
    for _ in range(50):
        sizes = np.array([1, *sorted(rng.sample(range(2, 3000), 40))])
        counts = np.array([4000, *(rng.randint(1, 50) for _ in range(40))])
        budget = rng.randint(0, int((sizes * counts).sum()))
        assert int((sizes * mix.fill(sizes, counts, budget)).sum()) == budget


@pytest.mark.parametrize("sizes", [[], [0], [0, 0, 5], [100, 1, 1], [1, 1, 1000, 7], [5] * 7, [1, 10**12, 3]])
def test_targets(sizes):
    how = mix.Mix()
    out = mix.targets(sizes, how)
    assert all(0 <= t <= 3 * s for t, s in zip(out, sizes))
    if sizes:
        assert sum(out) == sum(sizes)
    # Sources below their cap share by weight.
    free = [(t / how.weights[k % 3]) for k, (t, s) in enumerate(zip(out, sizes)) if t < 3 * s]
    assert all(a == b for a, b in itertools.pairwise(free))
    capped = [Fraction(3 * s, how.weights[k % 3]) for k, (t, s) in enumerate(zip(out, sizes)) if t == 3 * s]
    assert not free or all(c <= free[0] for c in capped)


def table(n=300):
    rng = random.Random(3)
    sources = ["a", "b", "B", "é", "😀", "\uffff", None, "", "n"]
    rows = [(k, " ".join(["w"] * rng.randint(0, 60)), rng.choice(sources if rng.random() < 0.6 else ["a"])) for k in range(n)]
    rows += [rows[5], rows[5], (None, "x y", "a"), (None, None, None), (7, "\t a\x0bb \n", "b"), (n, "long " * 30_000, "b")]
    return rows


def run(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return mix.plan(frame.withColumns({"key": frame.source, "size": frame.text, "n": frame.doc_id})).collect()


def test_plan(spark):
    rows = table()
    got = run(spark, rows)
    sizes = [len((t or "").encode().split()) for _, t, _ in rows]
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, n) for (i, _, s), n in zip(rows, sizes))
    order = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = [sum(n for (*_, s), n in zip(rows, sizes) if s == k) for k in order]
    want = dict(zip(order, mix.targets(total, mix.Mix())))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == total[order.index(r.source)]
        assert abs(r.target - float(want[r.source])) < 1e-6
        assert r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[r.source] += r.taken
    for k in order:
        own = [n for (*_, s), n in zip(rows, sizes) if s == k]
        # A document larger than what is to be filled cannot be taken once more.
        if max(own) < 1000:
            assert abs(taken[k] - want[k]) <= max(own)
        assert taken[k] <= want[k]
    assert sorted(map(tuple, run(spark, rows[::-1])), key=repr) == sorted(map(tuple, got), key=repr)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_fill_reaches_the_nearest_sum():
    """Against all reachable sums: few sizes, sparse stocks."""
    rng = random.Random(2)
    for _ in range(1500):
        sizes = rng.sample(range(60), rng.randrange(1, 6))
        counts = [rng.randrange(5) for _ in sizes]
        budget = rng.randrange(sum(s * c for s, c in zip(sizes, counts)) + 3)
        reach = {0}
        for s, c in zip(sizes, counts):
            reach = {r + k * s for r in reach for k in range(c + 1)}
        taken = mix.fill(np.array(sizes), np.array(counts), budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert int(np.array(sizes) @ taken) == max(r for r in reach if r <= budget), (sizes, counts, budget)


def test_fill_with_little_room():
    """Memory is that of the room, whatever the sizes; stock and budget still hold."""
    rng = random.Random(3)
    for _ in range(500):
        sizes = np.array(rng.sample(range(60), rng.randrange(1, 6)))
        counts = np.array([rng.randrange(9) for _ in sizes])
        budget = rng.randrange(int(sizes @ counts) + 2)
        taken = mix.fill(sizes, counts, budget, room=50)
        assert (taken >= 0).all() and (taken <= counts).all() and sizes @ taken <= budget
    assert mix.fill(np.array([1, 100_000_000]), np.array([5_000_000, 3]), 250_000_000).tolist() == [5_000_000, 2]
