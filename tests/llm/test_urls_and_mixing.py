import fnmatch
import random

import numpy as np

from analystry.llm import mixing, urls


def test_automaton_agrees_with_backtracking():
    draw = random.Random(3)
    globs = ["".join(draw.choice(["a", "b", "/", "?", "*", "**"]) for _ in range(draw.randint(1, 30))) for _ in range(60)]
    texts = [bytes(draw.choice(b"ab/") for _ in range(draw.randint(0, 14))) for _ in range(400)]

    def fits(glob, text):
        import re
        parts, k = "", 0
        while k < len(glob):
            if glob[k] == "*":
                double = glob[k:k + 2] == "**"
                parts += "(?s:.*)" if double else "[^/]*"
                k += 1 + double
            else:
                parts += "(?s:.)" if glob[k] == "?" else re.escape(glob[k])
                k += 1
        return re.fullmatch(parts.encode(), text) is not None

    found = urls.GlobAutomaton(globs).matches(texts)
    assert found.tolist() == [[fits(g, t) for g in globs] for t in texts]
    assert found.any() and fnmatch.fnmatchcase("ab", "a?")


def test_automaton_words_and_long_globs():
    globs = ["x" * 100 + "**", "y" * 63 + "*", "z"]
    found = urls.GlobAutomaton(globs).matches([b"x" * 100 + b"/q", b"x" * 99, b"y" * 63, b"y" * 63 + b"/", b"z", b""])
    assert found.tolist() == [[True, False, False], [False] * 3, [False, True, False], [False] * 3, [False, False, True], [False] * 3]


def test_urls_edge_cases(spark):
    long = "http://Ex.example.com/en/" + "a" * 200_000
    rows = [(1, "http://A.example.COM/en/x?q#f"), (2, "https://www.example.com/en/"), (3, None), (4, "no scheme"), (5, "http://x.net/es/1"), (6, "http://com"),
            (7, long), (8, "ftp://notcom/"), (9, "http://shop.org/ads/x"), (9, "http://shop.org/ads/x"), (10, "a://b.com/c://d/en/"), (11, "x://ÄB.com/\n/e")]
    pages = spark.createDataFrame([(i, u, "<p>", "clash", "c") for i, u in rows], "page_id long, url string, html string, host string, rule string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages).collect() if r["page_id"] != 7)
    assert got == sorted([
        (1, "a.example.com", "/en/x", "example.com/en/", "block"), (2, "www.example.com", "/en/", "www.example.com/en/", "allow"), (3, "", "", None, "allow"),
        (4, "", "", None, "allow"), (5, "x.net", "/es/1", "net/es/", "block"), (6, "com", "", None, "allow"), (8, "notcom", "/", None, "allow"),
        (9, "shop.org", "/ads/x", None, "block"), (9, "shop.org", "/ads/x", None, "block"), (10, "b.com", "/c://d/en/", "com/", "allow"), (11, "Äb.com", "/\n/e", "com/", "allow")],
        key=lambda r: (r[0],))
    assert urls.judge_urls(pages.where("page_id = 7")).first()["path"] == "/en/" + "a" * 200_000
    assert urls.judge_urls(pages.limit(0)).count() == 0


def targets(sizes, weights=(5, 2, 1), most=3):
    """By the rule as it is told: share, stop at the cap, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total = sum(sizes.values())
    fixed, free = {}, list(order)
    while free:
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = most * sizes[s]
            free.remove(s)
    return fixed


def test_mix_targets_and_takes(documents):
    draw = random.Random(5)
    rows = [(k, " ".join(["w"] * draw.choice([0, 1, 3, 40, 200])), draw.choice(["a", "b", "c", "d", None, "Z"])) for k in range(900)]
    rows += [(1000, None, "a"), (1001, "", "e"), (1002, "long " * 30_000, "d"), (1003, "w w w", "b"), (1003, "w w w", "b"), (None, "w w", "c")]
    docs = documents(rows, extra=True)
    got = [r.asDict() for r in mixing.mix_documents(docs).collect()]
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets(sizes)
    by_id = {r[0]: r[2] for r in rows}
    taken = {}
    for r in got:
        source = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[source] and abs(r["target"] - want[source]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
    total = sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= 0.002 * total for s in sizes)
    again = sorted(tuple(str(v) for v in r) for r in mixing.mix_documents(docs.repartition(7)).collect())
    assert again == sorted(tuple(str(v) for v in r.values()) for r in got)


def test_mix_of_nothing_and_of_one(documents):
    assert mixing.mix_documents(documents([])).count() == 0
    assert mixing.mix_documents(documents([(1, None, None), (2, "  ", "a")])).select("size", "taken").distinct().collect() == [(0, 0)]
    assert [tuple(r) for r in mixing.mix_documents(documents([(1, "a b c", None)])).collect()] == [(1, 3, 3, 3.0, 3)]
    rows = mixing.mixed_rows(documents([(k, "a b c d", "a" if k % 9 == 0 else "b") for k in range(90)], extra=True))
    counts = {s: n for s, n in rows.groupBy("source").count().collect()}
    assert counts["a"] == 30 and abs(counts["b"] - 60) <= 1


def test_slots_are_spread(spark):
    goals = mixing.source_targets(spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 1000)], "source string, source_size long"))
    slots = sorted((r["slot"], r["place"], r["rank"]) for r in mixing.slot_schedule(spark, goals, 3000).collect())
    places = np.array([p for _, p, _ in slots])
    for place, share in ((1, 5 / 8), (2, 2 / 8), (3, 1 / 8)):
        count = np.cumsum(places == place)
        assert np.abs(count - share * np.arange(1, 3001)).max() < 4
        assert [r for _, p, r in slots if p == place] == list(range(count[-1]))
