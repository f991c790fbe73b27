import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from analystry.operators import ordering as O
from analystry.operators import quantiles as Q
from analystry.operators import scorecard as S
from analystry.operators import statistics as T


def pairs(spark, x, y):
    return spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")


def test_ks_with_ties(spark):
    row = S.ks_stats(pairs(spark, [1, 2, 2, 3], [0, 1, 0, 1]), "x", "y").first()
    assert row["ks"] == pytest.approx(0.5)
    assert row["ks_mean"] == pytest.approx(0.375)
    assert row["ks_stability"] == pytest.approx(0.75)
    assert row["ks_entropy"] == pytest.approx(0.562335, abs=1e-6)


def test_auc_and_perfect_separation(spark):
    assert S.auc(pairs(spark, [1, 2, 2, 3], [0, 1, 0, 1]), "x", "y").first()["auc"] == pytest.approx(0.875)
    perfect = pairs(spark, [1, 2, 3, 4], [0, 0, 1, 1])
    assert S.auc(perfect, "x", "y").first()["auc"] == 1.0
    assert S.ks_stats(perfect, "x", "y").first()["ks"] == 1.0


def test_missing_scores_and_one_class(spark):
    df = pairs(spark, [1, 2, float("nan"), 3], [0, 1, 1, 1])
    assert S.auc(df, "x", "y").first()["auc"] == 1.0
    single = S.ks_stats(pairs(spark, [1, 2], [1, 1]), "x", "y").first()
    assert single["ks"] is None
    assert S.auc(pairs(spark, [1, 2], [1, 1]), "x", "y").first()["auc"] is None


def test_results_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(3)
    x, y = np.round(rng.normal(size=400), 1), rng.integers(0, 2, 400)
    df = pairs(spark, x, y)
    first = S.ks_stats(df, "x", "y").first()
    for n in (1, 7, 64):
        again = S.ks_stats(df.repartition(n), "x", "y").first()
        assert again["ks"] == pytest.approx(first["ks"], abs=1e-12)
    flipped = S.auc(df.withColumn("x", -F.col("x")), "x", "y").first()["auc"]
    assert flipped == pytest.approx(1 - S.auc(df, "x", "y").first()["auc"])


def test_hot_value_and_hot_group_are_exact(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 5}", 1.0 if i % 3 else float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, x double")
    got = {r["id"]: r["p"] for r in O.ordered_index(df, ["x", "id"], name="p").collect()}
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert got == want
    grouped = {(r["g"], r["id"]): r["p"] for r in O.ordered_index(df, ["id"], ["g"], name="p").collect()}
    for g in {r[1] for r in rows}:
        ids = sorted(r[0] for r in rows if r[1] == g)
        assert [grouped[(g, i)] for i in ids] == list(range(len(ids)))


def test_running_sum_ends_at_total(spark):
    df = pairs(spark, np.random.default_rng(0).integers(0, 50, 500), np.ones(500))
    last = O.prefix_sum(df, "x", {"n": F.lit(1)}).orderBy(F.desc("x")).first()
    assert last["cum_n"] == last["tot_n"] == 500
    assert O.prefix_sum(df.where("false"), "x", {"n": F.lit(1)}).count() == 0


def test_rank_bins_follow_the_ceiling_rule(spark):
    df = spark.range(12).select(F.col("id"), F.col("id").cast("double").alias("x"))
    bins = [r["b"] for r in O.rank_bin(df, "x", "id", 10, "b").orderBy("id").collect()]
    assert bins == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10, 10]


def test_woe_buckets_round_half_to_even(spark):
    df = pairs(spark, range(20), [i % 2 for i in range(20)])
    ranked = O.average_rank(df, "x").orderBy("x").select(F.bround(F.col("rank_share") * 10, 0).cast("int").alias("b"))
    assert [r["b"] for r in ranked.limit(8).collect()] == [0, 1, 2, 2, 2, 3, 4, 4]
    woe = S.weight_of_evidence(df, "x", "y").collect()
    assert sum(r["y"] for r in woe) == 10 and sum(r["noty"] for r in woe) == 10


def test_iv_does_not_change_under_monotone_transform(spark):
    df = pairs(spark, np.random.default_rng(5).normal(size=300), np.random.default_rng(6).integers(0, 2, 300))
    total = lambda d: d.agg(F.sum("iv")).first()[0]
    a = total(S.weight_of_evidence(df, "x", "y", signed=True))
    b = total(S.weight_of_evidence(df.withColumn("x", F.exp("x")), "x", "y", signed=True))
    assert a == pytest.approx(b) and a >= 0


def test_quantiles_match_numpy(spark):
    squares = spark.createDataFrame([(float(i * i),) for i in range(11)], "x double")
    assert Q.grouped_quantiles(squares, "x", [0.33]).first()["q0"] == pytest.approx(11.1)
    values = np.random.default_rng(1).normal(size=333)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = Q.grouped_quantiles(df, "x", [0.0, 0.025, 0.5, 0.99, 1.0]).first()
    for i, p in enumerate([0.0, 0.025, 0.5, 0.99, 1.0]):
        assert got[f"q{i}"] == pytest.approx(np.quantile(values, p), abs=1e-12)
    one = Q.grouped_quantiles(spark.createDataFrame([(4.0,)], "x double"), "x", [0.3]).first()
    assert one["q0"] == 4.0


def test_cumulative_share(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (1.0,), (6.0,)], "x double")
    assert T.cum_share(df, "x", 0.2).first()["percent"] == 20


def test_histogram_keeps_all_rows_and_handles_constants(spark):
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(2).normal(size=200)], "x double")
    assert T.histogram(df, "x", 30).agg(F.sum("n")).first()[0] == 200
    flat = T.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 4).first()
    assert flat["n"] == 2 and flat["lo"] <= 2.0 <= flat["hi"]


def test_constant_feature_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0), (2.0, 5.0, 1), (3.0, 5.0, 1)], "a double, b double, y int")
    got = {r["feature"]: r["r"] for r in T.corr_with_target(df, ["a", "b"], "y").collect()}
    assert got["b"] is None and got["a"] == pytest.approx(math.sqrt(3) / 2)
    assert T.most_correlated(df, ["a", "b"], "y").first()["feature"] == "a"


def test_mahalanobis_matches_numpy(spark):
    x = np.random.default_rng(4).normal(size=(60, 3)) @ np.array([[1, 0.3, 0], [0, 1, 0.5], [0, 0, 2]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    gap = x - x.mean(axis=0)
    want = np.sqrt(np.sum(gap @ np.linalg.inv(np.cov(gap.T)) * gap, axis=1))
    got = [r["distance"] for r in T.mahalanobis(df, ["a", "b", "c"]).orderBy("id").collect()]
    assert np.allclose(got, want)


def test_kde_integrates_to_one(spark):
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(9).normal(size=150)], "x double")
    rows = T.kde(df, "x", 80).orderBy("g").collect()
    assert np.trapezoid([r["density"] for r in rows], [r["g"] for r in rows]) == pytest.approx(1, abs=0.01)


def test_numbering_keeps_missing_keys_last(spark):
    rows = [(1, 2.0, "b"), (2, None, "a"), (3, float("nan"), "a"), (4, 1.0, None), (5, -1.0, None), (6, None, None)]
    df = spark.createDataFrame(rows, "id int, x double, g string")
    got = {r["id"]: (r["p"], r["n"]) for r in O.ordered_index(df, ["x", "id"], name="p", total="n").collect()}
    assert got == {5: (0, 6), 4: (1, 6), 1: (2, 6), 3: (3, 6), 2: (4, 6), 6: (5, 6)}
    grouped = {r["id"]: (r["p"], r["n"]) for r in O.ordered_index(df, ["x", "id"], ["g"], name="p", total="n").collect()}
    assert grouped == {1: (0, 1), 3: (0, 2), 2: (1, 2), 5: (0, 3), 4: (1, 3), 6: (2, 3)}


def test_shift_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(O, "SHIFT_BLOCK", 4)
    df = spark.range(0, 100).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE id * 10 END AS v", "id % 2 AS g")
    for steps in (1, 3, 40):
        got = {r["id"]: r["w"] for r in O.shift(df, "v", ["id"], steps, "w", fill=-1).collect()}
        value = {k: None if k % 7 == 0 else 10 * k for k in range(100)}
        assert got == {k: value[k - steps] if k >= steps else -1 for k in range(100)}
        got = {r["id"]: r["w"] for r in O.shift(df, "v", ["id"], steps, "w", fill=-1, by=["g"]).collect()}
        assert got == {k: value[k - 2 * steps] if k >= 2 * steps else -1 for k in range(100)}


def test_plan_of_numbering_does_not_grow_with_the_ranges(spark):
    df = spark.range(1000).selectExpr("id", "id % 10 AS x", "string(id % 3) AS g")
    sizes = [len(O.ordered_index(df, ["x", "g", "id"], ranges=n)._jdf.queryExecution().optimizedPlan().toString()) for n in (2, 40)]
    assert abs(sizes[0] - sizes[1]) < 200
