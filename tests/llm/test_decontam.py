import random

import numpy as np
import pytest

from txnscore.llm import decontam, shared

RULES = decontam.Rules()


def world(seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "a"] + ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 9))) for _ in range(1500)]
    weights = [200, 150, 120, 100] + [1] * 1500

    def prose(n):
        return " ".join(rng.choices(vocabulary, weights, k=n))

    items = [(k, f"{prose(rng.randint(8, 40))}? {prose(rng.randint(4, 15))}.") for k in range(60)]
    return prose, items


def test_wand_finds_what_scoring_all_finds():
    prose, items = world()
    index = decontam.Index(items, RULES)
    rng = random.Random(2)
    for _ in range(300):
        parts = rng.choice(items)[1].split()
        words = set(decontam.tokens(prose(20) + " " + " ".join(parts[: rng.randint(1, len(parts))])))
        for least in (0.05, 0.3, 0.5):
            scores = np.zeros(len(items))
            for w in words & set(index.lists):
                for n, x in zip(*index.lists[w][:2]):
                    scores[n] += x
            want = {n for n in range(len(items)) if scores[n] >= least}
            got = dict(index.search(words, least))
            assert set(got) == want
            assert all(abs(got[n] - scores[n]) < 1e-9 for n in want)


def test_full_text_of_an_item_has_its_whole_weight():
    _, items = world()
    index = decontam.Index(items, RULES)
    for n, (_, text) in enumerate(items):
        assert dict(index.search(set(decontam.tokens(text)), 0.99))[n] == pytest.approx(1)


@pytest.mark.parametrize(
    "text, parts",
    [
        ("Who is it? Nobody at all.", (["who", "is", "it"], ["nobody", "at", "all"])),
        ("One thing. Two things.", (["one", "thing"], ["two", "things"])),
        ("a b c d", (["a", "b"], ["c", "d"])),
        ("?", ([], [])),
        ("", ([], [])),
        ("word", ([], ["word"])),
    ],
)
def test_question_and_answer(text, parts):
    assert tuple([w.decode() for w in p] for p in decontam.question_and_answer(text)) == parts


def table():
    prose, items = world()
    rows = [(k, prose(300)) for k in range(40)]
    want = set()
    for k in range(40, 80):
        item, text = items[k - 40]
        place = [prose(k * 7), text, prose(50)]
        rows.append((k, " ".join(place) if k % 2 else "\n".join(place).upper()))
        want.add((k, item))
    rows += [(80, None), (81, ""), (82, "the of and a " * 50), (83, items[0][1].split("?")[0] + "? " + prose(40)), (None, items[1][1]), (84, items[2][1]), (84, items[2][1])]
    want |= {(None, 1), (84, 2)}
    return rows, items, want


def test_planted_items_are_found_and_nothing_else(spark, docs):
    rows, items, want = table()
    benchmark = spark.createDataFrame([*items, (7, items[7][1]), (900, None), (901, "")], "item_id long, text string")
    got = decontam.contaminated(docs(rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert len(got) == len(want) + 1  # the repeated row
    # In several blocks of items nothing changes.
    small = decontam.contaminated(docs(rows), benchmark, decontam.Rules(block_bytes=2000)).collect()
    assert {(r.doc_id, r.item_id) for r in small} == want
    frame = docs(rows)
    kept = decontam.keep_clean(frame, benchmark)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    frame = docs([(1, "a b c")])
    assert decontam.contaminated(frame, none).collect() == []
    assert decontam.keep_clean(frame, none).count() == 1
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.contaminated(frame.limit(0), items).collect() == []


def test_word_hashes_do_not_depend_on_the_place():
    data = np.frombuffer(b"alpha beta alpha", np.uint8)
    start, end, _ = shared.words_of(data, np.array([0, len(data)]))
    h = shared.word_hashes(data, start, end)
    assert h[0] == h[2] != h[1]


def test_statistics_are_those_of_all_items(spark, docs):
    """Blocks of any size find the same, with the same scores."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice([20, 40, 90, 300]))) + "? " + " ".join(rng.choices(words, k=12)) for _ in range(30)]
    bench = spark.createDataFrame(list(enumerate(texts)) + [(40, None), (41, "?!"), (3, texts[3])], "item_id long, text string")
    pairs = [(k, " ".join(rng.choices(words, k=50)) + " " + texts[k] + " " + " ".join(rng.choices(words, k=50))) for k in range(20)]
    pairs += [(100 + k, " ".join(rng.choices(words, k=200))) for k in range(20)] + [(200, None), (201, "")]
    given = docs(pairs)
    results = []
    for size in (8 << 20, 600):
        rules = decontam.Rules(block_bytes=size)
        assert len(decontam.build(bench, rules).numbers) == (3 if size > 1000 else len(decontam.build(bench, rules).numbers))
        got = decontam.contaminated(given, bench, rules).collect()
        results.append(sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in got))
        assert {(k, k) for k in range(20)} <= {(r["doc_id"], r["item_id"]) for r in got}
        assert sorted(r["doc_id"] for r in decontam.keep_clean(given, bench, rules).collect()) == [*range(100, 120), 200, 201]
    assert {x[:2] for x in results[0]} == {x[:2] for x in results[1]}


def test_a_very_long_item_keeps_to_its_own_block(spark, docs):
    """It widens no other item's passages; a text of several MB is searched whole."""
    long = " ".join(f"l{k}" for k in range(9_000)) + "? " + " ".join(f"a{k}" for k in range(50))
    short = "which river runs through the old town of the north? the river that never freezes in any winter"
    bench = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    filler = " ".join(f"f{k % 5000}" for k in range(500_000))
    got = decontam.contaminated(docs([(1, filler + " " + short), (2, "x " + long), (3, filler)]), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 2), (2, 1)}
    assert len(decontam.build(bench, decontam.Rules()).numbers) == 2
