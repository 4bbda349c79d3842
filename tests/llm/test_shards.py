import random
import zlib

import pytest

from txnscore.llm import shards


def brute(pairs, count):
    """Shard and slot of (id, text) pairs: NULL ids first, the shard of a row's middle byte."""
    rows = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0))
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    total, at, out, used = sum(sizes), 0, [], {}
    for (i, t), s in zip(rows, sizes):
        k = min(count - 1, (2 * at + s) * count // (2 * total))
        out.append((i, s, zlib.crc32((t or "").encode()), k, used.get(k, 0)))
        used[k] = used.get(k, 0) + 1
        at += s
    return out


@pytest.mark.parametrize("count", [1, 4, 16])
def test_against_running_sums_on_one_machine(spark, docs, count):
    rng = random.Random(3)
    pairs = [(i, "é" * rng.choice([0, 1, 5, 200])) for i in rng.sample(range(10_000), 700)] + [(20_000, None), (None, "x")]
    got = shards.assign(docs(pairs).repartition(7), count).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(pairs, count), key=str)


def test_shards_are_contiguous_and_near_equal(docs):
    pairs = [(i, "w" * (i % 50)) for i in range(3000)]
    got = sorted(shards.assign(docs(pairs)).collect())
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    sizes = [sum(r["size"] for r in got if r["shard"] == k) for k in range(16)]
    assert max(sizes) - min(sizes) <= 2 * 50


def test_one_hot_id_is_spread(docs):
    """Rows of one id fill several shards; each slot is taken once."""
    pairs = [(7, "same text") for _ in range(900)] + [(k, "a") for k in range(5)]
    got = shards.assign(docs(pairs).repartition(5), 8).collect()
    assert len(got) == 905 and len({(r["shard"], r["slot"]) for r in got}) == 905
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) >= 7
    for k in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_a_very_long_text_and_an_empty_table(spark, docs):
    got = {r["doc_id"]: r for r in shards.assign(docs([(0, "a"), (1, "b" * 3_000_000), (2, "")]), 4).collect()}
    assert got[1]["size"] == 3_000_001 and got[0]["shard"] <= got[1]["shard"] <= got[2]["shard"]
    assert shards.assign(docs([])).collect() == []


def test_written_shards_hold_the_rows_of_their_number(docs, tmp_path):
    pairs = [(i % 40, None if i % 9 == 0 else "t" * (i % 30)) for i in range(400)] + [(None, "n"), (None, None)]
    given = docs(pairs).repartition(6)
    written = shards.write(given, str(tmp_path / "out"), 5)
    assert sorted(map(str, written.drop("shard").collect())) == sorted(map(str, given.collect()))
    sizes = {}
    for r in written.collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + len((r["text"] or "").encode()) + 1
    assert sorted(sizes) == [0, 1, 2, 3, 4] and max(sizes.values()) - min(sizes.values()) <= 62
    with pytest.raises(ValueError, match="shard"):
        shards.write(written, str(tmp_path / "again"))


def test_no_python_on_the_way(docs):
    plan = shards.assign(docs([(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
