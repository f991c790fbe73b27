import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from analystry.operators import models as M
from analystry.operators import neighbours as K
from analystry.operators.logistic_tree import LogisticTree


def frame(spark, x, y):
    rows = [(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    return df.withColumn("features", array_to_vector("v"))


def brute_force(q, b, k, same=False):
    out = {}
    for i, a in enumerate(q):
        d = sorted((float(np.sqrt(((a - c) ** 2).sum())), j) for j, c in enumerate(b) if not (same and i == j))
        out[i] = [(j, round(v, 9)) for v, j in d[:k]]
    return out


@pytest.mark.parametrize("copies", [0, 80])
def test_neighbours_equal_brute_force(spark, copies, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(150, 4)), np.tile(rng.normal(size=(1, 4)), (copies, 1)), rng.normal(5, 0.1, size=(40, 4))])
    monkeypatch.setattr(K, "BLOCK", 16)
    df = frame(spark, x, np.zeros(len(x)))
    got = {}
    for r in K.knn_join(df, df, 7, "id", "id", "v", exclude_same_key=True).orderBy("query_id", "rnk").collect():
        got.setdefault(r["query_id"], []).append((r["base_id"], round(r["dist"], 9)))
    assert got == brute_force(x, x, 7, same=True)


def test_base_rows_without_a_key_hide_no_neighbour(spark):
    base = spark.createDataFrame([(None, [0.0, float(i)]) for i in range(4)] + [(i, [9.0, float(i)]) for i in range(5)], "id long, v array<double>")
    asked = spark.createDataFrame([(7, [0.0, 0.0])], "id long, v array<double>")
    assert [r["base_id"] for r in K.knn_join(asked, base, 3, "id", "id", "v").orderBy("rnk").collect()] == [0, 1, 2]


def test_query_blocks_hold_near_cells_and_split_large_ones():
    first, many, blocks = K._blocks_of(np.array([10, 10, 100, 0, 10]), np.array([[0.0], [9.0], [20.0], [30.0], [1.0]]), 5)
    assert (many[2], first[0], first[4]) == (4, 0, 0) and blocks == max(first + many)


def test_best_of_a_block_stay_bounded_while_cells_stream(spark, monkeypatch):
    import pyarrow as pa
    x = np.random.default_rng(3).normal(size=(400, 8))
    monkeypatch.setattr(K, "PAIRS_AT_ONCE", 64)
    found = K._Search(pa.array(np.arange(50)), x[:50], x[:1], 5, True)
    for at in range(0, 400, 40):
        # rows have two ids each; the second is larger
        ids = np.stack([np.arange(at, at + 40), np.arange(at, at + 40) + 1000], axis=1).ravel()
        found.add(0, np.inf, x[at:at + 40], np.arange(0, 81, 2), ids)
        assert found.held < 50 * 5 and found.dist.shape == (50, 5)
    rows = pa.Table.from_batches(list(found.answers())).to_pylist()
    d = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(axis=2))
    for i in range(50):
        best = sorted((round(float(d[i, j]), 9), b) for j in range(400) for b in (j, j + 1000) if b != i)[:5]
        assert sorted((round(r["dist"], 9), r["base_id"]) for r in rows if r["query_id"] == i) == best


def test_fewer_base_rows_than_neighbours(spark):
    df = frame(spark, np.eye(3), [0, 1, 2])
    assert K.knn_join(df, df, 10, "id", "id", "v").count() == 9
    assert K.knn_join(df, df.where("false"), 3, "id", "id", "v").count() == 0


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=80) > 0).astype(int)
    model = M.ridge_classifier(frame(spark, x, y), 2)
    t, xc = np.where(y == 1, 1.0, -1.0), x - x.mean(axis=0)
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ (t - t.mean()))
    assert np.allclose(model.weights[1], want, atol=1e-5)


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 2))
    y = (x @ [1.0, -2.0] + rng.normal(size=90) > 0).astype(int)
    a, w = np.c_[x, np.ones(90)], np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T * (p * (1 - p)) @ a + np.diag([1, 1, 0]), a.T @ (p - y) + np.r_[w[:2], 0])
    fit = M.logistic(90, family="binomial").fit(frame(spark, x, y))
    assert np.allclose(fit.coefficients.toArray(), w[:2], atol=1e-4)


def recursive_tree(x, y, depth, deepest):
    """The same tree on arrays, to check against."""
    if y.min() == y.max():
        return ("constant", y.mean())
    r = np.abs([np.corrcoef(c, y)[0, 1] for c in x.T])
    j = int(np.argmax(r))
    a, w = np.c_[x[:, j], np.ones(len(y))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve(a.T * (p * (1 - p)) @ a + np.diag([1, 0]), a.T @ (p - y) + np.r_[w[0], 0])
    out = a @ w > 0
    if depth < deepest and 0 < out.sum() < len(y):
        return ("partial", j, w, recursive_tree(x[~out], y[~out], depth + 1, deepest), recursive_tree(x[out], y[out], depth + 1, deepest))
    return ("complete", j, w)


def tree_probability(tree, row):
    if tree[0] == "constant":
        return tree[1]
    p = 1 / (1 + np.exp(-(tree[2][0] * row[tree[1]] + tree[2][1])))
    return p if tree[0] == "complete" else tree_probability(tree[4] if p > 0.5 else tree[3], row)


def test_logistic_tree_equals_the_recursive_one(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.uniform(size=120) < 0.1)).astype(int)
    df = frame(spark, x, y)
    model = LogisticTree(maxDepth=3).fit(df)
    tree = recursive_tree(x, y, 0, 3)
    got = [r["p"] for r in model.transform(df).orderBy("id").select(M.class_probability("probability", 1).alias("p")).collect()]
    assert np.allclose(got, [tree_probability(tree, r) for r in x], atol=1e-5)
    lines = model.tree_lines(spark).collect()
    assert len(lines) == len(model.nodes) and lines[0]["line"].startswith("root")


def test_tree_on_one_class_and_constant_features(spark):
    pure = LogisticTree().fit(frame(spark, np.eye(3), [1, 1, 1]))
    assert pure.nodes[0][3] == "constant" and pure.nodes[0][7] == 1.0
    flat = LogisticTree().fit(frame(spark, np.ones((4, 2)), [0, 1, 1, 1]))
    assert flat.nodes[0][3] == "constant" and flat.nodes[0][7] == 0.75


def test_online_models_and_boosting_learn_separable_data(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(-2, 0.5, (40, 2)), rng.normal(2, 0.5, (40, 2))])
    y = np.repeat([0, 1], 40)
    df = frame(spark, x, y)
    for model in (M.online_linear(df, 2, "perceptron", 5), M.online_linear(df, 2, "passive", 5), M.ada_boost(df, 2, 3)):
        assert model.transform(df).where(F.col("prediction") == F.col("label")).count() == 80


def test_pca_centres_and_keeps_enough(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(70, 4)) * [5, 2, 0.01, 0.01] + 100
    models, out = M.centred_pca(frame(spark, x, np.zeros(70)), "features", "p", variance=0.99)
    assert len(models[-1].getIndices()) == 2
    first = np.abs([r["f"] for r in out.orderBy("id").select(M.class_probability("p", 0).alias("f")).collect()])
    centred = x - x.mean(axis=0)
    assert np.allclose(first, np.abs(centred @ np.linalg.svd(centred, full_matrices=False)[2][0]), atol=1e-6)


def test_authorship_versions_on_a_small_collection(spark):
    from analystry.plans.authorship import attribute
    styles = {"a": "the cat sat on the mat and the cat ran ", "b": "of wine and bread she sang, of wine! ", "c": "12 numbers 34 go 56 up 78 "}
    rows, i = [], 0
    for problem in ("p", "q"):
        for label, line in styles.items():
            for k in range(5):
                role = "unknown" if k == 4 else "candidate"
                rows.append((i, problem, {"p": "en", "q": "fr"}[problem], role, label, f"{label}{k}.txt", line * (k + 2)))
                i += 1
    docs = spark.createDataFrame(rows, "doc_id long, problem string, language string, role string, label string, filename string, text string")
    for version in (1, 2):
        found = attribute(docs, version, iterations=15, folds=2, strengths=(0.1, 1.0)).collect()
        assert len(found) == 6
        assert all(r["unknown-text"].startswith(r["predicted-author"]) for r in found)


def test_tree_without_depth_limit(spark):
    x = 2.0 ** np.arange(24)[:, None]  # every fit splits off the largest values only
    y = np.arange(24) % 2
    free = LogisticTree().fit(frame(spark, x, y))
    tree = recursive_tree(x, y, 0, 60)
    assert max(n[2] for n in free.nodes) > 5
    got = [r["p"] for r in free.transform(frame(spark, x, y)).orderBy("id").select(M.class_probability("probability", 1).alias("p")).collect()]
    assert np.allclose(got, [tree_probability(tree, r) for r in x], atol=1e-4)
    ids = [n[0] for n in free.nodes]
    assert len(ids) == len(set(ids)) and sum(n[8] for n in free.nodes if n[10] is None) == len(x)


def test_wide_projection_equals_the_full_decomposition(spark):
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(4)
    x = np.where(rng.uniform(size=(30, 2500)) < 0.02, rng.exponential(size=(30, 2500)), 0.0)
    rows = [(k, Vectors.sparse(2500, {int(j): float(v[j]) for j in np.flatnonzero(v)}) if k % 2 else Vectors.dense(v)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["id", "features"])
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    share = s ** 2 / (s ** 2).sum()
    kept = int(np.searchsorted(np.cumsum(share), 0.9 - 1e-9)) + 1
    mean, components, shares = M.truncated_pca(df, "features", 0.9)
    assert components.shape == (2500, kept) and np.allclose(shares, share[:kept], atol=1e-8) and np.allclose(components.T @ components, np.eye(kept), atol=1e-9)
    got = np.array([r["p"] for r in M.project(df, "features", "p", mean, components).orderBy("id").select(vector_to_array("p").alias("p")).collect()])
    assert np.allclose(np.abs(got), np.abs(centred @ vt[:kept].T), atol=1e-7)


def test_narrow_features_take_one_pass_and_hopeless_rounds_are_left_out(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors
    rng, once, passes = np.random.default_rng(5), M._covariance_times, []
    monkeypatch.setattr(M, "_covariance_times", lambda *a: passes.append(1) or once(*a))
    for width, most in ((40, 1), (2500, 10)):
        x = np.where(rng.uniform(size=(100, width)) < 0.3, rng.normal(size=(100, width)), 0.0)
        rows = [(Vectors.sparse(width, {int(j): float(r[j]) for j in np.flatnonzero(r)}),) for r in x]
        _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        share = s ** 2 / (s ** 2).sum()
        kept = int(np.searchsorted(np.cumsum(share), 0.95 - 1e-9)) + 1
        passes.clear()
        _, components, shares = M.truncated_pca(spark.createDataFrame(rows, ["features"]), "features", 0.95)
        assert len(passes) <= most and np.allclose(shares, share[:kept], atol=1e-9)
        assert np.allclose(np.abs((components * vt[:kept].T).sum(axis=0)), 1, atol=1e-6)


def test_blocks_of_very_many_features(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors
    x, q = np.random.default_rng(6).normal(size=(20, 30)), np.eye(30)[:, :4]
    rows = spark.createDataFrame([(Vectors.sparse(30, {j: float(r[j]) for j in range(k % 3, 30, 3)}),) for k, r in enumerate(x)], ["f"])
    kept = np.where(np.arange(30) % 3 == np.arange(20)[:, None] % 3, x, 0.0)
    monkeypatch.setattr(M, "PCA_DENSE", 16)
    found = M._covariance_times(rows.select(M.entries("f").alias("e")).select("e.i", "e.v"), kept.mean(axis=0), q, 20)
    assert np.allclose(found, np.cov(kept.T) @ q)


def test_elimination_passes_have_at_most_one_task_per_core(spark, monkeypatch):
    n, fit, seen = spark.sparkContext.defaultParallelism, M.C.LinearSVC.fit, []
    rows = spark.range(400, numPartitions=5 * n).select(
        (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") % 2) * 2 - 1 + F.sin("id") / 10).alias("a"), F.cos("id").alias("b"), F.sin(F.col("id") * 7).alias("c"))

    def counted(self, df):
        seen.append(df.rdd.getNumPartitions())
        return fit(self, df)

    monkeypatch.setattr(M.C.LinearSVC, "fit", counted)
    assert "a" in M.recursive_elimination(rows, ["a", "b", "c"], "y", keep=2)
    assert len(seen) == 1 and max(seen) <= n


def test_elimination_fits_the_least_hinge_loss(spark):
    x = np.random.default_rng(2).normal(size=(300, 6))
    y = (x @ [3.0, -2.0, 1.0, 0.5, 0.2, 0.0] + np.random.default_rng(3).normal(size=300) > 0).astype(int)
    blocks = spark.sparkContext.parallelize([(x[:200], 2.0 * y[:200] - 1), (x[200:], 2.0 * y[200:] - 1)], 2)
    w = M._hinge_weights(blocks, [0, 1, 2], np.zeros(4), M.BENDS, 1.0)
    value = lambda w: (w[:3] @ w[:3]) / 2 + np.maximum(0, 1 - (2 * y - 1) * (x[:, :3] @ w[:3] + w[3])).sum()
    draw = np.random.default_rng(4)
    assert all(value(w) <= value(w + draw.normal(scale=s, size=4)) * (1 + 1e-3) for s in (1e-3, 1e-2, 0.1, 1.0) for _ in range(50))


def test_elimination_query_takes_all_dimensions(spark, tmp_path):
    from analystry.registry import QUERIES

    # only the last five of 64 dimensions tell label 1 from the others
    draw = np.random.default_rng(5)
    rows = [(i, [float(v) for v in np.append(draw.normal(scale=0.1, size=59), (2 * (i % 2 == 1) - 1) + draw.normal(scale=0.5, size=5))], 1 if i % 2 else 3) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["model_feature_elimination"](spark, str(tmp_path)).columns == [f"f{i}" for i in range(59, 64)]


def test_topics_of_a_large_vocabulary_stay_in_rows(spark, monkeypatch):
    from analystry.plans import words as V

    # two planted topics of 30 words each, every document of one of them
    rows = spark.range(2000).select(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(
        F.when(F.col("id") % 2 == 0, "x").otherwise("y"), F.pmod(F.xxhash64("id", i), F.lit(30)).cast("string"))).alias("words"))
    monkeypatch.setattr(V, "LDA", None)
    found = V.topics(rows, "words", k=2, n_top=30, most_terms=10)
    assert found.columns == ["topic", "term", "weight", "rnk", "share"]
    got = found.collect()
    assert len(got) == 60 and [r["rnk"] for r in got if r["topic"] == 0] == list(range(1, 31))
    of = {t: [r["term"][0] for r in got if r["topic"] == t] for t in (0, 1)}
    heads = {max("xy", key=of[t].count) for t in of}
    assert heads == {"x", "y"}


def test_digamma_and_trigamma():
    from analystry.plans.words import digamma, trigamma

    assert digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-10) and digamma(0.5) == pytest.approx(-1.9635100260214235, abs=1e-10)
    assert trigamma(1.0) == pytest.approx(np.pi ** 2 / 6, abs=1e-9) and trigamma(0.5) == pytest.approx(np.pi ** 2 / 2, abs=1e-9)
