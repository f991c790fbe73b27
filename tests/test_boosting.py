import numpy as np
from test_sparse_linear import frame

from analystry.operators import models as M
from analystry.operators import sparse_linear as S
from analystry.operators.boosting import ada_boost


def samme(x, y, classes, rounds):
    """The same on arrays, one split after another."""
    w, out = np.ones(len(y)), []
    for _ in range(rounds):
        best = None
        for f in range(x.shape[1]):
            for value in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= value
                sides = [np.bincount(y[s], w[s], classes) for s in (left, ~left)]
                impurity = round(sum(s.sum() - (s ** 2).sum() / s.sum() for s in sides) / w.sum(), 12)
                if best is None or impurity < best[0]:
                    best = (impurity, f, value, *[int(s.argmax()) for s in sides])
        _, f, value, low, high = best
        miss = np.where(x[:, f] <= value, low, high) != y
        error = w[miss].sum() / w.sum()
        if error >= 1 - 1 / classes:
            break
        alpha = np.log((1 - error) / max(error, 1e-12)) + np.log(classes - 1)
        out.append((f, value, low, high, alpha))
        w = w * np.where(miss, np.exp(alpha), 1)
    return out


def test_boosting_equals_samme_on_arrays(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 40)
    draw = np.random.default_rng(3)
    x = draw.integers(0, 9, (150, 4)).astype(float)
    y = np.clip((x[:, 0] + x[:, 1] > 8).astype(int) + (x[:, 2] > 5), 0, 2)
    model, want = ada_boost(frame(spark, x, y), 3, rounds=15), samme(x, y, 3, 15)
    assert len(model.stumps) == len(want)
    for s, (f, value, low, high, alpha) in zip(model.stumps, want):
        assert (s.feature, s.low, s.high) == (f, low, high) and abs(s.alpha - alpha) < 1e-9
        assert ((x[:, f] <= s.cut) == (x[:, f] <= value)).all()
    scored = [r for r in model.transform(frame(spark, x, y)).collect() if r["prediction"] is not None]
    assert all(r["prediction"] == model.scores(r["features"].toArray()[None]).argmax() for r in scored) and len(scored) == 151
    assert ada_boost(frame(spark, x, y).where("false"), 3).stumps == []


def test_bootstrap_does_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    ids = spark.range(20_000)
    for replica in (0, 1):
        few, many = (sorted(map(tuple, ids.repartition(n).select("id", M.bootstrap_weight(F.col("id"), replica)).collect())) for n in (2, 9))
        assert few == many
        times = np.array([t for _, t in few])
        assert abs(times.mean() - 1) < 0.03 and abs(times.var() - 1) < 0.05 and abs((times == 0).mean() - np.exp(-1)) < 0.015
    draw = np.random.default_rng(4)
    x = draw.normal(size=(120, 3))
    y = (x[:, 0] > 0).astype(int)
    data = frame(spark, x, y).where("label IS NOT NULL AND features IS NOT NULL").select("label", "features")
    scores = []
    for n in (2, 7):
        voted = M.bagging(data.repartition(n), lambda: M.logistic(120, maxIter=20), replicas=3).transform(data)
        scores.append(sorted((r["features"].toArray().tolist(), round(float(r["probability"][0]), 6)) for r in voted.collect()))
    assert scores[0] == scores[1]
