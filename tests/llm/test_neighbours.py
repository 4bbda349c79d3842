import numpy as np

from txnscore.llm import neighbours


def brute(rows):
    n = len(rows)
    unit = []
    for _, v, label in rows:
        sound = label is not None and v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v)
        scaled = np.array(v) / np.abs(v).max() if sound else None
        unit.append(scaled / np.linalg.norm(scaled) if sound else None)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    names = {}
    for k in range(n):
        i = rows[k][0]
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return [(rows[k][0], links[k], names.get(find(k)), names.get(find(k)) is not None and names.get(find(k)) == rows[k][0]) for k in range(n)]


def table(seed=1, width=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(25):
        base = rng.standard_normal(width)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (base + rng.standard_normal(width) * 0.22).round(3).tolist(), int(rng.integers(0, 3))))
    rows += [(500, rows[3][1], rows[3][2]), (2, rows[9][1], rows[9][2]), rows[4], (None, rows[6][1], rows[6][2]), (501, rows[3][1], None)]
    rows += [(502, None, 1), (503, [0.0] * width, 1), (504, [float("nan")] + [1.0] * (width - 1), 1), (505, [None] + [1.0] * (width - 1), 1), (506, [float("inf")] * width, 1), (507, [], 1)]
    rows += [(508, [1.0, 2.0], 1), (509, [1.0, 2.1], 1), (510, [1e-200, 2e-200], 1), (511, [1e300, 2e300], 1), (None, None, None)]
    return rows


def run(spark, rows, forest):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = neighbours.link(frame.withColumns({"leaf": frame.label, "vec": frame.vec_id}), forest).collect()
    return sorted([tuple(r) for r in found], key=repr)


def test_all_links_in_one_leaf(spark):
    rows = table()
    assert run(spark, rows, neighbours.Forest()) == sorted(brute(rows), key=repr)


def test_blocks_of_a_large_leaf(spark):
    rows = table(2)
    assert run(spark, rows, neighbours.Forest(trees=2, cell=20)) == sorted(brute(rows), key=repr)


def test_recall_over_many_leaves(spark):
    rows = table(3)
    want, got = brute(rows), run(spark, rows, neighbours.Forest(leaf=16, spill=0.08, trees=10))
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)
    most = {}
    for i, n, *_ in want:
        most[i] = max(n, most.get(i, 0))
    assert all(n <= most[i] for i, n, *_ in got)


def test_recall_of_the_default_forest_at_full_depth():
    forest, n, cosine = neighbours.Forest(), 10_000, 0.931
    rng = np.random.default_rng(11)
    one, off = rng.standard_normal((2, n, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    off -= (off * one).sum(axis=1, keepdims=True) * one
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    vectors = np.concatenate([one, cosine * one + np.sqrt(1 - cosine**2) * off])
    row, leaf = neighbours.leaves(neighbours.fit(vectors, forest.deepest, forest), vectors, forest.spill)
    edge = np.searchsorted(row, np.arange(2 * n + 1))
    of = [set(leaf[edge[k] : edge[k + 1]].tolist()) for k in range(2 * n)]
    assert sum(not of[k].isdisjoint(of[k + n]) for k in range(n)) >= 0.999 * n


def test_leaves_that_are_split_on(spark):
    """Two driver levels, then levels fitted in tasks; links are counted once, whatever leaf a pair meets in."""
    rows = table(4)
    forest = neighbours.Forest(leaf=12, cell=24, deepest=2, spill=0.08, trees=10)
    want, got = brute(rows), run(spark, rows, forest)
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)
    most = {}
    for i, n, *_ in want:
        most[i] = max(n, most.get(i, 0))
    assert all(n <= most[i] for i, n, *_ in got)


def test_a_cluster_tighter_than_the_spill_is_compared_in_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    rows = [(k, (base + 1e-4 * rng.standard_normal(8)).tolist(), 1) for k in range(120)]
    got = run(spark, rows, neighbours.Forest(leaf=8, cell=20, deepest=2))
    assert got == sorted(((k, 119, 0, k == 0) for k in range(120)), key=repr)


def work(n, forest):
    """Pairs compared for n vectors of one label, driver levels and further ones, as the operator places them."""
    vectors = np.random.default_rng(7).standard_normal((n, 24))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    depth = 0
    while depth < forest.deepest and n * 0.6**depth > forest.leaf:
        depth += 1
    row, leaf = neighbours.leaves(neighbours.fit(vectors[:2000], depth, forest), vectors, forest.spill)
    waiting, pairs = [(k, row[leaf == k], np.inf) for k in np.unique(leaf).tolist()], 0
    while waiting:
        k, own, was = waiting.pop()
        if len(own) <= forest.cell or len(own) >= 0.9 * was:
            pairs += len(own) ** 2
            continue
        cuts = neighbours.sub_fit(k, vectors[own[: neighbours.SUB_SAMPLE]], len(own), forest)
        at, sub = neighbours.sub_leaves(k, vectors[own], cuts, forest)
        waiting += [(x, own[at[sub == x]], len(own)) for x in np.unique(sub).tolist()]
    return pairs


def test_ten_times_the_vectors_are_less_than_fifteen_times_the_work():
    forest = neighbours.Forest(leaf=64, cell=256, deepest=3, trees=2, spill=0.02)
    assert work(60_000, forest) < 15 * work(6_000, forest)


def test_empty_table(spark):
    assert run(spark, [], neighbours.Forest()) == []
