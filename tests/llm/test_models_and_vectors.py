import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from analystry.llm import quality, topk, toxicity, vectors
from analystry.llm.components import connected_components


def segments_by_definition(scores):
    """Maximal scoring segments by divide and conquer: the best contiguous one (shortest, leftmost), then both sides of it."""
    def best(low, high):
        found = None
        for a in range(low, high):
            total = 0.0
            for b in range(a, high):
                total += scores[b]
                if total > 1e-12 and (found is None or total > found[2] + 1e-12 or (abs(total - found[2]) <= 1e-12 and b + 1 - a < found[1] - found[0])):
                    found = (a, b + 1, total)
        return [] if found is None else best(low, found[0]) + [found] + best(found[1], high)
    return best(0, len(scores))


def test_maximal_segments():
    draw = random.Random(1)
    for _ in range(60):
        scores = [draw.uniform(-2, 1.5) for _ in range(draw.randint(0, 30))]
        got = toxicity.maximal_segments(np.array(scores))
        want = segments_by_definition(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and np.allclose([s for *_, s in got], [s for *_, s in want])


def labelled(prose, n=600):
    bad = "vile nasty rotten awful wretch".split()
    rows, labels = [], []
    for k in range(n):
        words, toxic = prose(k, 40 + k % 60).split(), k % 4 == 0
        if toxic:
            at = k % 30
            words[at:at] = [bad[k % 5], bad[(k + 1) % 5], bad[(k + 3) % 5]]
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 3 > 0), int(toxic)))
    return rows, labels


def test_toxicity_finds_held_out_passages(spark, documents, prose):
    rows, labels = labelled(prose)
    table = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    more = [(None, "vile"), (9000, None), (9001, ""), (9002, "word " * 50_000), (0, rows[0][1])]
    got = toxicity.score_documents(documents(rows + more, extra=True), table).collect()
    assert len(got) == len(rows) + len(more) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < len(rows)]
    right = [r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]
    assert len(held) > 80 and np.mean(right) > 0.97
    kept = toxicity.without_toxic(documents(rows + more, extra=True), table)
    assert kept.count() == sum(1 - r["predicted"] for r in got)


def test_toxicity_ignores_held_out_labels(spark, documents, prose):
    rows, labels = labelled(prose, 150)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    scores = [sorted((r["doc_id"], r["score"]) for r in toxicity.score_documents(documents(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())
              for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_toxicity_without_labels_or_documents(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score_documents(documents([(1, "a"), (2, None)]), none).collect()} == {0.5}
    assert toxicity.score_documents(documents([]), none).count() == 0


def test_quality_posteriors(spark, documents, prose):
    rows = []
    for k in range(900):
        junk = k % 3 == 0 if k < 600 else k % 10 == 0
        text = " ".join(w + "%%%" for w in prose(k, 60).split()) if junk else prose(k, 60).capitalize() + "."
        rows.append((k, text, "low.net/x" if k < 600 else "high.org"))
    labels = spark.createDataFrame([(k, int(not (k % 3 == 0 if k < 600 else k % 10 == 0)), 0) for k in range(0, 900, 2)], "doc_id long, quality int, toxic int")
    more = [(9000, None, None), (9001, "", "tiny.com/a/b"), (9002, "w " * 50_000, "high.org"), (None, "a b.", "high.org"), (0, rows[0][1], "low.net/x")]
    got = quality.quality_posteriors(documents(rows + more, extra=True), labels).collect()
    assert len(got) == len(rows) + len(more) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert np.mean([r["kept"] == (not (r["doc_id"] % 3 == 0 if r["doc_id"] < 600 else r["doc_id"] % 10 == 0)) for r in held]) > 0.97
    rate = {r["host"]: r["host_rate"] for r in got}
    assert rate["low.net"] < rate["high.org"] and rate["low.net"] < rate["tiny.com"] < rate["high.org"]
    assert quality.quality_posteriors(documents([]), labels.limit(0)).count() == 0


def test_connected_components(spark):
    draw = random.Random(3)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(700, k) for k in range(600, 690)] + [(900, 900)]
    want = brute.components({x for link in links for x in link}, links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


ODD = [(8001, None, 1), (8002, [], 1), (8003, [0.0] * 8, 1), (8004, [1.0] + [None] * 7, 1), (8005, [float("nan")] + [1.0] * 7, 1), (8006, [float("inf")] + [1.0] * 7, 1), (8007, [1.0] * 8, None), (8008, [1.0] * 5, 1)]


def vector_rows(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(size=8).astype("f4").tolist(), int(k % 3)) for k in range(500)]
    for k in range(500, 800):
        base = np.array(rows[k % 40][1])
        rows.append((k, (base + rng.normal(size=8) * rng.choice([0, 0.1, 0.3, 0.6])).astype("f4").tolist(), rows[k % 40][2]))
    return rows


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, "x") for i, v, l in rows], "vec_id long, embedding array<float>, label int, id int, unit string")


@pytest.mark.parametrize("block, cell", [(2048, 256), (16, 8)])
def test_near_vectors_against_all_pairs(spark, monkeypatch, block, cell):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CELL_ROWS", cell)
    rows = vector_rows() + ODD
    usable = {i: (np.array(v, float), l) for i, v, l in rows if i < 8000 or i == 8008}
    links = []
    for a, (x, l) in usable.items():
        for b, (y, m) in usable.items():
            if a < b and l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links.append((a, b))
    component = brute.components([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = {r["vec_id"]: tuple(r)[1:] for r in vectors.near_vectors(table_of(spark, rows)).collect()}
    assert len(links) > 500 and got == {i: (n[i], component[i], component[i] == i) for i in n}


def test_near_vectors_of_nothing(spark):
    assert vectors.near_vectors(table_of(spark, [])).count() == 0
    assert {tuple(r) for r in vectors.near_vectors(table_of(spark, ODD[:3])).collect()} == {(i, 0, i, True) for i in (8001, 8002, 8003)}


def test_traversal_visits_in_order():
    first, second = [0.0, 0.1, 0.5, 0.9], [0.0, 0.2, 0.3]
    got = list(vectors.traversal(first, second, 0.65))
    sums = [first[i] + second[j] for i, j in got]
    assert sums == sorted(sums) and set(got) == {(i, j) for i in range(4) for j in range(3) if first[i] + second[j] <= 0.65}


@pytest.mark.parametrize("tree, pivots", [(8192, 64), (40, 6)])
def test_top_matches_against_all_pairs(spark, monkeypatch, tree, pivots):
    monkeypatch.setattr(topk, "TREE_ROWS", tree)
    monkeypatch.setattr(topk, "MOST_PIVOTS", pivots)
    rows = vector_rows() + [(k, [0.5] * 8, 1) for k in range(900, 960)] + ODD + [(None, [1.0] * 8, 1)]
    usable = {i: np.floor(1024 * np.array(v, float)).astype(int) for i, v, _ in rows if i is not None and (i < 8000 or i in (8002, 8003, 8007, 8008))}
    want = set()
    for q, x in usable.items():
        if q % 100 == 0:
            scored = sorted((-int(x[:min(len(x), len(y))] @ y[:min(len(x), len(y))]), i) for i, y in usable.items() if i != q)[:10]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    got = topk.best_matches(table_of(spark, rows), F.col("vec_id") % 100 == 0)
    assert {tuple(r) for r in got.collect()} == want
    few = topk.best_matches(table_of(spark, [(100, [1.0], 1), (1, [2.0], 1), (2, [2.0], 1)]), F.col("vec_id") % 100 == 0)
    assert [tuple(r) for r in few.orderBy("rank").collect()] == [(100, 1, 1, 2 * 1024 * 1024), (100, 2, 2, 2 * 1024 * 1024)]
    assert topk.best_matches(table_of(spark, []), F.col("vec_id") % 100 == 0).count() == 0
