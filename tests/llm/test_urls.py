from collections import Counter

import pytest

from txnscore.llm import urls
from txnscore.llm.queries import URL_RULES

CASES = [
    ("http://A.Example.COM/en/1?x#y", "a.example.com", "/en/1"),
    ("https://www.example.com/en/", "www.example.com", "/en/"),
    ("HTTP://x.net", "x.net", ""),
    ("http://x.net?/es/", "x.net", ""),
    ("http://x.net#a/es/", "x.net", ""),
    ("x.net/es/1", "", ""),
    ("", "", ""),
    (None, "", ""),
    ("a://b://c/d", "b:", "//c/d"),
    ("://É.net/es/ü\n?q", "É.net", "/es/ü\n"),
    ("x\n://net/fr/", "net", "/fr/"),
    ("http://notnet/fr/1", "notnet", "/fr/1"),
    ("http://example.com/english", "example.com", "/english"),
    ("http://u@h.com:80/EN/", "u@h.com:80", "/EN/"),
    ("http://h.com/" + "a/" * 400, "h.com", "/" + "a/" * 400),
]


def rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def run(spark, rows, how=urls.Filter()):
    frame = spark.createDataFrame(rows, "page_id long, url string")
    return urls.judge(frame.withColumns({"host": frame.url, "n": frame.page_id}), URL_RULES, how).collect()


def test_hosts_paths_and_rules(spark):
    rows = [(k, u) for k, (u, *_) in enumerate(CASES)] + [(3, CASES[3][0]), (None, CASES[1][0])]
    got = run(spark, rows)
    assert Counter(r.page_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        _, host, path = CASES[1 if r.page_id is None else r.page_id]
        assert (r.host, r.path) == (host, path)
        want = rule(host, path)
        assert r.rule == (want.name if want else None)
        if want:
            assert r.verdict == want.verdict


def test_templates_generalise_and_judge(spark):
    rows = []
    for k in range(60):
        # Hosts with numbers and keys; on one the labels of the branches differ.
        rows.append(f"http://h.example.net/es/item-{k}/{k:032x}")
        rows.append(f"http://h.example.net/fr/item-{k}/{k:032x}")
        rows.append(f"http://g.example.net/en/item-{k}/{k:032x}")
        rows.append(f"http://g.example.net/es/item-{k}/{k:032x}")
        rows.append(f"http://o.example.org/user{k}x/profile")
    got = run(spark, list(enumerate(rows)))
    by = Counter((r.host, r.template, r.verdict) for r in got)
    assert by["g.example.net", "/en/item-{num}/{hex}", "allow"] == 60
    assert by["g.example.net", "/es/item-{num}/{hex}", "block"] == 60
    # Two branches with the same labels and the same continuation are one.
    assert by["h.example.net", "/*/item-{num}/{hex}", "block"] == 120
    assert sum(n for (h, t, v), n in by.items() if h == "o.example.org" and v == "allow") == 60


def test_unlabelled_urls_of_a_bad_template_are_blocked(spark):
    rules = [urls.Rule("x.org", f"/ads/{k}/", urls.BLOCK) for k in range(100, 140)]
    pages = [f"http://x.org/ads/{k}/{k}" for k in range(100, 160)] + [f"http://x.org/news/{k}/{k}" for k in range(100, 160)]
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(frame, rules).collect()}
    assert all(got[k].verdict == "block" for k in range(60))
    assert got[59].rule is None and got[59].purity >= 0.7


@pytest.mark.parametrize("bad, good", [("a/b/c/d/ads", "a/b/c/d/news"), ("a/b/c/d/e/f/g/ads", "a/b/c/d/e/f/h/news"), ("promotions-and-advertisements-of-partners", "international-news-and-weather-reports")])
def test_deep_and_long_segments_are_told_apart(spark, bad, good):
    rules = [urls.Rule("x.org", f"/{bad}/{k}/", urls.BLOCK) for k in range(100, 140)]
    pages = [f"http://x.org/{bad}/{k}/{k}" for k in range(100, 160)] + [f"http://x.org/{good}/{k}/{k}" for k in range(100, 160)]
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(frame, rules).collect()}
    assert {got[k].template for k in range(60)} == {f"/{bad}/{{num}}/{{num}}"}
    assert {got[k].template for k in range(60, 120)} == {f"/{good}/{{num}}/{{num}}"}
    assert [got[k].verdict for k in range(120)] == ["block"] * 60 + ["allow"] * 60


def test_long_segments_that_go_on_alike_are_one(spark):
    word = "abcdefghijklmnopqrstuvwxyz"
    pages = [f"http://x.org/p/q/r/s/t/{word[k:]}-{word[:k]}-and-more/view" for k in range(26)]
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    assert {r.template for r in urls.judge(frame, []).collect()} == {"/p/q/r/s/t/*/view"}


@pytest.mark.parametrize("rows", [[]])
def test_empty_table(spark, rows):
    assert run(spark, rows) == []


def judged(spark, pages, rules=()):
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    return {r.page_id: r.template for r in urls.judge(frame, list(rules)).collect()}


def test_segments_that_look_like_marks(spark):
    """A dollar sign, a star and braces of a path are no end, wildcard or placeholder."""
    got = judged(spark, ["http://h/a/$/x", "http://h/a", "http://i/*/x", "http://i/{num}/y", "http://j/{num}/7", "http://j/{num}"])
    assert got[0] == "/a/$/x" and got[1] == "/a"
    assert got[4] == r"/\{num\}/{num}" and got[5] == r"/\{num\}"
    # Two rare branches of one host are one wildcard, which no segment can be taken for.
    assert (got[2], got[3]) == ("/*/x", "/*/y") or got[2] == got[3] == "/*/*"
    one = judged(spark, ["http://i/*/x"])
    assert one == {0: r"/\*/x"}


def test_crawler_traps_take_few_rounds(spark, monkeypatch):
    """Three hundred levels: a path that repeats itself, and branches at every level."""
    rounds = []
    real = urls.materialize
    monkeypatch.setattr(urls, "materialize", lambda df, tag: rounds.append(tag) or real(df, tag))
    trap = ["http://t/" + "/".join(["loop"] * k) for k in range(1, 301)]
    wide = ["http://w/" + "/".join(f"x{chr(97 + (k * 7 + d) % 26)}{k}q{d}" for d in range(300)) for k in range(12)]
    got = judged(spark, trap + wide)
    assert all(got[k] == "/" + "/".join(["loop"] * (k + 1)) for k in range(300))
    assert all(got[300 + k].count("/") == 300 for k in range(12))
    assert len(rounds) <= 6


def templates_by_hand(paths, few):
    """The tree of one host without decided runs: level by level, in plain Python."""
    from math import sqrt

    out = {}
    nodes = {"": [(p, p.removeprefix("/").split("/")) for p in paths]}
    while nodes:
        after = {}
        for template, rows in nodes.items():
            branches = {}
            for p, rest in rows:
                branches.setdefault(rest[0] if rest else None, []).append((p, rest[1:]))
            traits = {}
            for key, own in branches.items():
                for _, rest in own:
                    follow = "/" + (rest[0] if rest else "#")
                    for t in ("none", follow):
                        traits.setdefault(t, {}).setdefault(key, 0)
                        traits[t][key] += 1
            whole = sum(sum(x.values()) for x in traits.values())
            free = max(1, len(traits) - 1)
            limit = free * (1 - 2 / (9 * free) + 2.326 * sqrt(2 / (9 * free))) ** 3
            alike = set()
            for key, own in branches.items():
                n = 2 * len(own)
                ratio = sum(x[key] ** 2 / (n * sum(x.values()) / whole) for x in traits.values() if key in x)
                if key is not None and (ratio - n <= limit or n < few):
                    alike.add(key)
            for key, own in branches.items():
                if key is None:
                    out.update({p: template for p, _ in own})
                    continue
                step = template + ("/*" if key in alike and len(alike) > 1 else "/" + key)
                after.setdefault(step, []).extend(own)
        nodes = after
    return out


def test_templates_against_a_tree_by_hand(spark):
    import random

    rng = random.Random(9)
    words = ["news", "sport", "item", "user", "view", "edit", "tag", "page"]
    paths = sorted({"/" + "/".join(rng.choice(words[: rng.choice([2, 4, 8])]) for _ in range(rng.randrange(1, 6))) for _ in range(300)})
    frame = spark.createDataFrame([("h", p, 0, 0, 1) for p in paths], "host string, path string, n_allow long, n_block long, n_none long")
    got = {r.path: r.template for r in urls.templates(frame).collect()}
    assert got == templates_by_hand(paths, urls.Filter().few)
