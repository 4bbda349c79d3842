import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from txnscore.llm import queries, runs


def brute(words):
    """Every run by comparing all words at all lags."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        x = 0
        while x < n - q:
            y = x
            while y < n - q and words[y] == words[y + q]:
                y += 1
            piece = words[x : y + q]
            if y > x and len(piece) >= max(6, 4 * q) and not any(piece[p:] == piece[:-p] for p in range(1, q)):
                out.append((x, y + q - x, q))
            x = y + 1 if y == x else y
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(words):
    kinds = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.array([*(kinds[w] for w in words), len(kinds)], np.int64)


def random_words(rng):
    n, words = rng.randrange(90), []
    words = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(n)]
    for _ in range(rng.randrange(4) if n else 0):
        a, p = rng.randrange(n), rng.randrange(1, 14)
        for i in range(a, rng.randrange(a, n + 1)):
            words[i] = words[a + (i - a) % p]
    return words


def test_runs_against_brute_force():
    rng, found = random.Random(5), 0
    for _ in range(1500):
        words = random_words(rng)
        want = brute(words)
        assert runs.runs_of(numbered(words)) == want, words
        found += len(want)
    assert found > 500


@pytest.mark.parametrize("words", [["a"] * 20_000, list("ab" * 9_000 + "c"), [str(i % 997) for i in range(20_000)], [str(i) for i in range(9_000)] * 2, ["0" if i % 3 else "1" for i in range(5_000)]])
def test_long_texts(words):
    """Few, long pieces: a whole run is one; two copies of a text are none."""
    got = runs.runs_of(numbered(words))
    if words[0] == words[1]:
        assert got == [(0, len(words), 1)]
    elif len(set(words)) == 9_000:
        assert got == []
    elif len(set(words)) == 997:
        assert got == [(0, 20_000, 997)]
    else:
        assert got and got[0][2] in (2, 3)


def expected(doc_id, text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\x20\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    n, h = len(words), 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *figures, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(rest))


def test_query_against_brute_force(spark, docs, monkeypatch):
    """All columns of the query; NULL ids, NULL, empty and blank texts, repeated rows, odd blanks."""
    rng = random.Random(8)
    pairs = [(i, rng.choice([" ", "  ", "\t", " é "]).join(random_words(rng))) for i in range(400)]
    pairs += [(None, "x " * 8), (500, None), (501, ""), (502, " \t\n"), (3, pairs[3][1]), (503, "a b " * 4), (504, "é\x1cé " * 9), (505, "\x0b".join("ab" * 30))]
    monkeypatch.setattr(queries, "_table", lambda *_: docs(pairs))
    got = queries.QUERIES["op11_periodic_runs"](spark, "")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted((expected(*p) for p in pairs), key=str)


def test_operator_keeps_text_and_spans(docs):
    text = "one two " + "go on " * 5 + "end"
    got = runs.find(docs([(1, text), (2, "plain  words")])).orderBy("doc_id").collect()
    assert [tuple(r) for r in got[0]["runs"]] == [(2, 10, 2)]
    assert got[0]["collapsed"] == "one two go on end" and got[0]["n_words"] == 13
    assert got[1]["runs"] == [] and got[1]["collapsed"] == "plain words"


def test_one_very_long_text(docs):
    """Longer than a chunk and an Arrow batch: 5 MB, one run of 40 words."""
    period = [f"w{i}" for i in range(40)]
    text = " ".join(f"x{i}" for i in range(400_000)) + " " + " ".join(period * 50_000)
    (row,) = runs.find(docs([(9, text)])).collect()
    assert [tuple(r) for r in row["runs"]] == [(400_000, 2_000_000, 40)]
    assert row["collapsed"].endswith(" ".join(period)) and row["n_words"] == 2_400_000


def test_empty_table(docs):
    assert runs.find(docs([])).collect() == []
