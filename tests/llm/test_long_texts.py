"""Texts longer than a chunk (1 MB) and than a bucket (8 MB): every byte and word counts."""

import hashlib
import random

import numpy as np

from txnscore.llm import fmindex, jaccard, suffixes


def noise(seed, n):
    return bytes(np.random.default_rng(seed).integers(97, 123, n, dtype=np.uint8)).decode()


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_bytes_of_long_texts(docs):
    one = noise(1, 9_000_000)
    passage = one[4_000_000:4_300_000]
    two = noise(2, 1_500_000) + passage + noise(3, 1_200_000)
    got = {r["doc_id"]: r for r in suffixes.dedup_bytes(docs([(1, one), (2, two), (3, passage[:60])])).collect()}
    assert [tuple(s) for s in got[2]["spans"]] == [(1_500_000, 1_800_000)]
    assert got[1]["spans"] == [] and got[1]["n_bytes"] == 9_000_000
    assert hashlib.sha256(bytes(got[2]["kept"])).digest() == hashlib.sha256((two[:1_500_000] + two[1_800_000:]).encode()).digest()
    assert [tuple(s) for s in got[3]["spans"]] == [(0, 60)]


def test_words_of_long_texts(docs):
    one = words(1, 900_000)
    passage = one[300_000:350_000]
    two = words(2, 150_000) + passage + words(3, 150_000)
    got = {r["doc_id"]: r for r in fmindex.dedup_words(docs([(1, " ".join(one)), (2, " ".join(two))])).collect()}
    assert [tuple(s) for s in got[2]["spans"]] == [(150_000, 200_000)]
    assert got[1]["spans"] == [] and got[1]["n_words"] == 900_000
    assert got[2]["kept_text"] == " ".join(two[:150_000] + two[200_000:])


def test_sets_of_long_texts(docs):
    one = words(5, 400_000)
    near = one[:380_000] + words(6, 20_000)
    far = one[:200_000] + words(7, 200_000)
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(docs([(1, " ".join(one)), (2, " ".join(near)), (3, " ".join(far))])).collect()}
    assert [got[k]["component_id"] for k in (1, 2, 3)] == [1, 1, 3]
    assert got[1]["n_shingles"] == 400_000 - 4
