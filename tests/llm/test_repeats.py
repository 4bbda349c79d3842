"""Suffix-array and FM-index deduplication against brute force."""

import random

import numpy as np
import pytest

from txnscore.llm import fmindex, suffixes, windows

LAST = 2**63 - 1


def runs(flags):
    out = []
    for k, f in enumerate(flags):
        if f and (not k or not flags[k - 1]):
            out.append([k, k])
        if f:
            out[-1][1] = k + 1
    return [tuple(x) for x in out]


def brute_bytes(rows, length):
    least = {}
    for i, t in rows:
        b, i = (t or "").encode(), LAST if i is None else i
        for p in range(len(b) - length + 1):
            least[b[p : p + length]] = min(least.get(b[p : p + length], LAST), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        flags = [False] * len(b)
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < (LAST if i is None else i):
                flags[p : p + length] = [True] * length
        out.append((i, len(b), runs(flags), bytes(x for x, f in zip(b, flags) if not f)))
    return out


def brute_words(rows, window):
    least = {}
    for i, t in rows:
        w, i = (t or "").encode().split(), LAST if i is None else i
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            least[key] = min(least.get(key, (LAST, LAST)), (i, p))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        flags = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < (LAST if i is None else i, p):
                flags[p : p + window] = [True] * window
        out.append((i, len(w), runs(flags), b" ".join(x for x, f in zip(w, flags) if not f).decode()))
    return out


def texts(rng, unit, n):
    """Texts of repeated passages, with every odd case among them."""
    passages = ["".join(rng.choice(unit) for _ in range(rng.randint(5, 40))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.6 else rng.choice(unit) for _ in range(rng.randint(0, 12)))) for i in range(n)]
    rows += [(3, rows[5][1]), (n, rows[7][1]), (n + 1, None), (n + 2, ""), (n + 3, " \t\n"), (None, rows[2][1]), (None, rows[9][1]), (None, None)]
    rows += [rows[8], rows[8], (n + 4, rows[8][1]), (n + 5, "é" * 60), (n + 6, "ü" + "é" * 50), (n + 7, "a" * 300), (n + 8, "\x00" * 40 + "a" * 40)]
    rng.shuffle(rows)
    return rows


def spans(found):
    return [(s["start"], s["stop"]) for s in found]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_bytes(docs, monkeypatch, hot):
    scheme = windows.Scheme
    monkeypatch.setattr(suffixes, "Scheme", lambda **x: scheme(**x, hot=hot, bucket_bytes=1000))
    rows = texts(random.Random(hot), ["a", "b", "ab", "é", "c d ", "x"], 40)
    found = suffixes.dedup_bytes(docs(rows), length=12, gram=5).collect()
    got = [(r.doc_id, r.n_bytes, spans(r.spans), bytes(r.kept)) for r in found]
    assert ordered(got) == ordered(brute_bytes(rows, 12))


@pytest.mark.parametrize("hot", [20_000, 2])
def test_words(docs, monkeypatch, hot):
    scheme = windows.Scheme
    monkeypatch.setattr(fmindex, "Scheme", lambda **x: scheme(**x, hot=hot, bucket_bytes=1000))
    rows = texts(random.Random(hot + 1), ["a ", "b\n", "ab\t", "é ", "c d  ", "x\x0b"], 40)
    found = fmindex.dedup_words(docs(rows), window=6, gram=3).collect()
    got = [(r.doc_id, r.n_words, spans(r.spans), r.kept_text) for r in found]
    assert ordered(got) == ordered(brute_words(rows, 6))


def test_empty_table(docs):
    assert suffixes.dedup_bytes(docs([(1, "a")]).limit(0)).collect() == []
    assert fmindex.dedup_words(docs([(1, "a")]).limit(0)).collect() == []


def test_suffix_arrays_are_sorted():
    rng = random.Random(4)
    for _ in range(100):
        parts = [[rng.randint(1, 3) for _ in range(rng.randint(0, 40))] + [0] for _ in range(rng.randint(1, 6))]
        start = np.cumsum([0] + [len(x) for x in parts])
        got = suffixes.suffix_arrays(np.array(sum(parts, []), np.int16), start).tolist()
        assert got == [s + i for s, x in zip(start.tolist(), parts) for i in sorted(range(len(x)), key=lambda i, x=x: x[i:])]


def test_many_snippets_under_a_key_are_matched_alike():
    rng = random.Random(5)
    rows = ["".join(rng.choice("ab") for _ in range(rng.randint(12, 20))).encode() for _ in range(3 * suffixes.SNIPPETS)]
    rows = sorted(set(rows))
    snippet, offset, kind = suffixes.match([1] * len(rows), rows, 12)
    seen = {}
    for s, o, k in zip(snippet, offset, kind):
        assert seen.setdefault(k, rows[s][o : o + 12]) == rows[s][o : o + 12]
    assert len(seen) == len(set(seen.values()))


def test_matching_statistics():
    index = fmindex.FMIndex(np.array([1, 2, 3, 1, 2, 4, 0, 2, 3, 1, 0]), 4)
    query = np.array([1, 2, 3, 1, 2, 4, 2, 4])
    length, _ = index.lengths(query, np.arange(1, 9), 4)
    text = [1, 2, 3, 1, 2, 4, 0, 2, 3, 1, 0]
    for end, n in zip(range(1, 9), length):
        fits = [k for k in range(min(4, end) + 1) if any(text[p : p + k] == query[end - k : end].tolist() for p in range(len(text)))]
        assert n == max(fits)
