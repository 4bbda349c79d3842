import math
import random
import re

import numpy as np
import pytest

from txnscore.llm import ranking
from txnscore.llm.ranking import Layout

TINY = Layout(shard=400, block=3, window=5)
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """Every document scored for every item, from the definition."""
    listed = [(i, terms(t)) for i, t in docs]
    listed = [(i, t) for i, t in listed if t]
    count, total = len(listed), sum(len(t) for _, t in listed)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        weight = {}
        for term in wanted:
            df = sum(term in t for _, t in listed)
            if df:
                weight[term] = math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))
        scored = []
        for doc, t in listed:
            m = 50 + 50 * len(t) * count // total
            score = sum(w * (10**9 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x, w in weight.items())
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(60)] + ["É", "straße", "A1", "THE"]
    odds = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" .".join(rng.choices(vocabulary, odds, k=rng.choice([1, 3, 20, 90]))) for _ in range(300)]
    pairs = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    # Repeated rows and texts, ids met twice, no id, no text, no terms.
    pairs += [pairs[5], pairs[6], (2000, pairs[7][1]), (pairs[8][0], "t1 t2"), (None, "t3 t1"), (None, "t3 t1"), (2001, None), (2002, ""), (2003, " -- ")]
    items = [(i, " ".join(rng.sample(vocabulary, rng.choice([1, 2, 5, 30])))) for i in range(25)]
    items += [(3, "t9 t40"), (None, "t3 t5"), (90, None), (91, ""), (92, "nowhere"), (93, "T1 t1 t1")]
    return pairs, items


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "text AS term", "item_id AS shard")


@pytest.mark.parametrize("layout, parts", [(Layout(), 1), (TINY, 5), (Layout(shard=3000, block=2, window=7), 2)])
def test_against_scoring_everything(spark, docs, corpus, layout, parts):
    pairs, items = corpus
    index = ranking.build(docs(pairs).repartition(parts), layout)
    for k in (50, 4):
        got = ranking.search(index, items_of(spark, items), k, layout)
        assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(pairs, items, k)


def test_items_are_served_in_blocks(spark, docs, corpus, monkeypatch):
    pairs, items = corpus
    monkeypatch.setattr(ranking, "ITEMS", 3)
    monkeypatch.setattr(ranking, "GROUPS", 4)
    index = ranking.build(docs(pairs).repartition(3), TINY)
    got = ranking.search(index, items_of(spark, items), 10, TINY)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(pairs, items, 10)


def test_empty_tables(spark, docs):
    none = items_of(spark, [])
    index = ranking.build(docs([]))
    assert (index.documents, index.terms) == (0, 0)
    assert ranking.search(index, items_of(spark, [(1, "a")])).collect() == []
    assert ranking.search(ranking.build(docs([(1, "a b")])), none).collect() == []


def test_a_very_long_text_is_a_shard_of_its_own(spark, docs):
    pairs = [(1, "alpha " * 900_000 + "omega"), (2, "alpha omega"), (3, "omega " * 3)]
    got = ranking.search(ranking.build(docs(pairs)), items_of(spark, [(5, "omega alpha")]), 3)
    assert sorted(map(tuple, got.collect()), key=str) == brute(pairs, [(5, "omega alpha")], 3)


def test_packing():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**31, 2**55], np.int64)
    data, ends = ranking.packed(values)
    assert ranking.unpacked(data).tolist() == values.tolist() and ends[-1] == len(data)


def test_non_essential_blocks_stay_packed():
    """Once the floor has risen, a common term's blocks are opened only where a candidate may win."""
    rng = np.random.default_rng(1)
    n = 20_000
    texts = [b"rare common " + b"x " * 5 if k < 400 and k % 20 == 0 else b"common " + b"x " * int(rng.integers(5, 60)) for k in range(n)]
    rows = [r for b in ranking.shard_lists(0, list(range(n)), texts, n, 40 * n, 128) for r in b.to_pylist()]
    about = next(r for r in rows if r["term"] == "")
    norm = np.frombuffer(about["ends"], "<i8")

    rare, common = (ranking._List({**next(r for r in rows if r["term"] == t), "weight": w}, norm) for t, w in (("rare", 9000), ("common", 1)))
    top, _ = ranking.best([rare, common], n, 20, 256)
    assert top.tolist() == list(range(0, 400, 20))
    assert len(common.known) < 10 < len(common.lasts)
