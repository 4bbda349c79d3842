"""Near duplicates against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from txnscore.llm import jaccard


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return frozenset({tuple(words)} if words else ())
    return frozenset(zip(*(words[k:] for k in range(5))))


def brute(rows, roots=False):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    names = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    if roots:
        return [(len(sets[k]), find(k)) for k in range(len(rows))]
    return [(i, len(sets[k]), names[find(k)]) for k, (i, _) in enumerate(rows)]


def table():
    rng = random.Random(8)
    vocabulary = ["w%d" % k for k in range(400)]
    line = " ".join(rng.choice(vocabulary) for _ in range(12))
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((6, 30, 80, 200)))]
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
            rows.append((len(rows), text + " " + line if rng.random() < 0.4 else text))
    # A chain of neighbours whose ends are not similar.
    chain = [rng.choice(vocabulary) for _ in range(120)]
    rows += [(len(rows) + k, " ".join(chain[k * 4 : k * 4 + 60])) for k in range(12)]
    rows += [(900, rows[3][1].upper()), (2, rows[7][1]), rows[5], rows[5], (None, rows[4][1]), (None, "only here some words for null"), (901, None), (902, ""), (903, " \n"), (904, "a b"), (905, "A\tb"), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("paired, block", [(32, 1024), (1, 5), (1, 1024)])
def test_components(docs, monkeypatch, paired, block):
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = table()
    got = [tuple(r) for r in jaccard.near_duplicates(docs(rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_one_of_each_group_stays(docs):
    rows = table()
    frame = docs(rows)
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns
    blank = sum(not n for n, _ in brute(rows, roots=True))
    got = kept.collect()
    assert len(got) == blank + len({r for n, r in brute(rows, roots=True) if n})
    named = {c for _, n, c in brute(rows) if n and c is not None}
    assert {r.doc_id for r in got if shingles(r.text)} - {None} == named


def test_empty_table(docs):
    assert jaccard.near_duplicates(docs([(1, "a")]).limit(0)).collect() == []
    assert jaccard.keep_one(docs([(1, "a")]).limit(0)).collect() == []


def test_filters_lose_no_similar_pair():
    rng = np.random.default_rng(1)
    near = jaccard.Near()
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 62, int(rng.integers(0, 4))).astype(np.uint64)]))
        if len(b):
            both = len(np.intersect1d(a, b))
            alike = 100 * both >= 80 * (len(a) + len(b) - both)
            assert jaccard.similar(near, a, b) == alike
            if alike:
                assert jaccard.passes(near, len(a), jaccard.sketch(near, a), len(b), jaccard.sketch(near, b))


def test_filters_leave_out_sets_that_only_share_a_part():
    rng = np.random.default_rng(2)
    near = jaccard.Near()
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
        b = np.unique(np.concatenate([a[:160], rng.integers(0, 1 << 62, 240).astype(np.uint64)]))
        assert not jaccard.passes(near, len(a), jaccard.sketch(near, a), len(b), jaccard.sketch(near, b))


def test_joins_without_broadcasts_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW_KEYS", 0)
    rows = table()
    got = [tuple(r) for r in jaccard.near_duplicates(docs(rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
