"""Settings over Spark ML that follow the usual library parameters, and the few models built here."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import classification as C
from pyspark.ml.feature import PCA, StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from analystry.operators.boosting import ada_boost  # noqa: F401
from analystry.operators.sparse_linear import entries, l1_then_svm, online_linear, ridge_classifier, sgd_linear, svm_classifier  # noqa: F401


def centred_pca(df: DataFrame, features: str, output: str, variance: float | None = None,
                components: int | None = None) -> tuple:
    """((mean model, pca model, slicer), projected df): centre, fit once, keep enough components.

    `variance` keeps the first components that together explain that share.
    """
    centre = StandardScaler(inputCol=features, outputCol="_centred", withMean=True, withStd=False).fit(df)
    centred = centre.transform(df)
    width = centre.mean.size
    model = PCA(k=components or width, inputCol="_centred", outputCol="_all").fit(centred)
    kept = model.getK()
    if variance is not None:
        kept = min(int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), variance - 1e-12)) + 1, width)
    first = VectorSlicer(inputCol="_all", outputCol=output, indices=list(range(kept)))
    models = (centre, model, first)
    return models, apply_pca(models, df)


def apply_pca(models: tuple, df: DataFrame) -> DataFrame:
    for model in models:
        df = model.transform(df)
    return df.drop("_centred", "_all")


#: Rows of a block of the features x components matrix that one task adds up.
PCA_BLOCK = 2048
#: Up to so many features a block of rows is multiplied as it is, above that by the features it has.
PCA_DENSE = 1 << 16
#: Numbers of a block of rows.
PCA_CELLS = 1 << 22


def _covariance_times(rows: DataFrame, mean: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """Covariance times basis without the covariance: each task adds up its rows' share, blocks of features are summed apart."""
    context = rows.sparkSession.sparkContext
    sent = context.broadcast((mean @ basis, basis))

    def share(batches):
        middle, q = sent.value
        total, sums = np.zeros_like(q), np.zeros(q.shape[1])
        step, all_of = max(8, min(256, PCA_CELLS // len(q))), slice(None)
        for batch in batches:
            for low in range(0, len(batch), step):
                part = batch.iloc[low:low + step]
                i, v = np.concatenate(part["i"].to_list()).astype(int), np.concatenate(part["v"].to_list())
                row, used, height = np.repeat(np.arange(len(part)), part["i"].map(len)), all_of, len(q)
                if len(q) > PCA_DENSE:
                    used, i = np.unique(i, return_inverse=True)
                    height = len(used)
                dense = np.zeros((len(part), height))
                dense[row, i] = v
                z = dense @ q[used] - middle
                total[used] += dense.T @ z
                sums += z.sum(axis=0)
        yield pd.DataFrame({
            "block": np.arange(-1, -(-len(q) // PCA_BLOCK)),
            "part": [sums.tobytes(), *[total[k:k + PCA_BLOCK].tobytes() for k in range(0, len(q), PCA_BLOCK)]]})

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(p) for p in parts["part"]], axis=0)
        return pd.DataFrame({"block": parts["block"].iloc[:1], "part": [total.tobytes()]})

    summed = rows.mapInPandas(share, "block int, part binary").groupBy("block").applyInPandas(added, "block int, part binary")
    parts = {r["block"]: np.frombuffer(r["part"]) for r in summed.collect()}  # features x components numbers
    sums = parts.pop(-1)
    total = np.concatenate([parts[b] for b in sorted(parts)]).reshape(basis.shape)
    return (total - np.outer(mean, sums)) / max(n - 1, 1)


def truncated_pca(df: DataFrame, features: str, variance: float, rounds: int = 8, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components as columns, variance shares) of the first components that explain `variance`, for wide sparse vectors.

    Up to PCA_BLOCK features decompose their covariance, made in one pass. More take subspace iteration on as many directions as are
    needed: they are doubled until the wanted share is reached or the rank is used up, at once when the rounds left cannot reach it.
    Vectors stay sparse, and neither a wide features x features matrix nor the rows reach the driver.
    """
    from pyspark.ml.stat import Summarizer

    seen = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(features)).alias("s")).select("s.*").first()
    mean, n, total = seen["mean"].toArray(), seen["count"], float(seen["variance"].toArray().sum())
    rows = df.select(entries(features).alias("e")).select("e.i", "e.v")
    rank = max(1, min(n - 1, len(mean)))
    if total <= 0:
        return mean, np.zeros((len(mean), 1)), np.zeros(1)
    if len(mean) <= PCA_BLOCK:
        image = _covariance_times(rows, mean, np.eye(len(mean)), n)
        values, components = np.linalg.eigh((image + image.T) / 2)
        shares = np.maximum(values[::-1], 0) / total
        kept = min(int(np.searchsorted(np.cumsum(shares), variance - 1e-9)) + 1, rank)
        return mean, components[:, ::-1][:, :kept], shares[:kept]
    draw, k = np.random.default_rng(seed), min(32, rank)
    basis = np.linalg.qr(draw.normal(size=(len(mean), k)))[0]
    while True:
        share = 0.0
        for left in range(2 if k == rank else rounds, -1, -1):
            image = _covariance_times(rows, mean, basis, n)
            before, share = share, float((basis * image).sum()) / total
            # a round brings less than the one before it; giving up too early only costs directions
            if not left or (k < rank and before > 0 and share + left * max(share - before, 0.0) < variance):
                break
            basis = np.linalg.qr(image)[0]
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        order = np.argsort(-values)
        shares, components = np.maximum(values[order], 0) / total, basis @ turn[:, order]
        if k == rank or shares.sum() >= variance:
            kept = min(int(np.searchsorted(np.cumsum(shares), variance - 1e-9)) + 1, k)
            return mean, components[:, :kept], shares[:kept]
        more = min(2 * k, rank)
        basis = np.linalg.qr(np.column_stack([components, draw.normal(size=(len(mean), more - k))]))[0]
        k = more


def project(df: DataFrame, features: str, output: str, mean: np.ndarray, components: np.ndarray) -> DataFrame:
    """df with `output`, the centred vectors in the components' coordinates."""
    sent = df.sparkSession.sparkContext.broadcast((mean @ components, components))

    def turn(indices: pd.Series, values: pd.Series) -> pd.Series:
        middle, c = sent.value
        return pd.Series([v @ c[i] - middle for i, v in zip(indices, values)])

    places = entries(features)
    turned = F.pandas_udf(turn, "array<double>")(places["i"], places["v"])
    return df.withColumn(output, array_to_vector(turned))


def logistic(n: int, c: float = 1.0, **options) -> C.LogisticRegression:
    """L2 logistic regression whose penalty equals 1/C on the summed loss of n rows."""
    settings = {"family": "multinomial", "maxIter": 200, "tol": 1e-8, **options}
    return C.LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, **settings)


#: Strengths that cross-validation tries: ten, evenly spaced in the exponent from -4 to 4.
EXPONENTS = tuple(-4 + 8 * k / 9 for k in range(10))


def logistic_cv(n: int, folds: int = 3, exponents: Sequence[float] = EXPONENTS, **options):
    """Choose C from 10^exponents by cross-validation on n rows; a fold is fitted on (folds - 1) / folds of them, and so is the penalty."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    base = logistic(n, **options)
    grid = ParamGridBuilder().addGrid(base.regParam, [1.0 / (10.0 ** e * n * (folds - 1) / folds) for e in exponents]).build()
    judge = MulticlassClassificationEvaluator(
        metricName="accuracy", labelCol=base.getLabelCol(), predictionCol=base.getPredictionCol())
    return CrossValidator(estimator=base, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=0, parallelism=2)


#: Widths of the bend that stands for the kink of the hinge loss: the first fit goes through all of them, later ones take the last.
BENDS = (0.3, 0.1, 0.03, 0.01, 0.003, 0.001)
#: Rows of a block whose share of a step is found at once.
HINGE_ROWS = 4096


def _hinge_share(blocks, left: list[int], point: np.ndarray, bend: float) -> list[np.ndarray]:
    """[loss, gradient, curvature] over blocks of (x, signs) of the hinge loss with a rounded kink; the last weight is the intercept."""
    loss, g, h = 0.0, np.zeros(len(point)), np.zeros((len(point), len(point)))
    for x, sign in blocks:
        a = np.column_stack([x[:, left], np.ones(len(x))])
        gap = 1 - sign * (a @ point)
        slope = np.clip(gap / bend, 0, 1)
        near = a[(gap >= 0) & (gap <= bend)]
        loss += float((slope * (gap - bend * slope / 2)).sum())
        g -= (sign * slope) @ a
        h += near.T @ near / bend
    return [np.concatenate([[loss], g, h.ravel()])]


def _hinge_weights(blocks, left: list[int], point: np.ndarray, bends: Sequence[float], c: float, tolerance: float = 1e-7) -> np.ndarray:
    """The least |w|^2 / 2 + c * summed hinge loss by damped Newton steps, each one pass; the intercept is free."""
    k = len(point)
    free = np.append(np.ones(k - 1), 0.0)

    def at(p: np.ndarray, bend: float) -> tuple[float, np.ndarray, np.ndarray]:
        total = c * np.sum(blocks.mapPartitions(lambda b: _hinge_share(b, left, p, bend)).collect(), axis=0)
        return total[0] + (free * p * p).sum() / 2, total[1:k + 1] + free * p, total[k + 1:].reshape(k, k) + np.diag(free)

    for bend in bends:
        loss, g, h = at(point, bend)
        damp = 0.0
        for _ in range(100):
            size = max(np.trace(h) / k, 1.0)
            damp = max(damp, 1e-9 * size)
            d = -np.linalg.solve(h + damp * np.eye(k), g)
            fall = -float(g @ d)
            if fall <= tolerance * max(loss, 1e-300) or np.abs(d).max() < 1e-12:
                break
            there = at(point + d, bend)
            if there[0] <= loss - 1e-4 * fall:
                point, (loss, g, h), damp = point + d, there, damp / 16
            else:
                damp = max(32 * damp, 1e-6 * size)
    return point


def recursive_elimination(df: DataFrame, features: Sequence[str], label: str, keep: int = 5, c: float = 1.0) -> list[str]:
    """Drop the feature with the smallest squared weight of a linear SVM until `keep` are left. Labels are 0 and 1, nothing may be null.

    The first fit is Spark's. Every further one starts from the weights of the one before it, so it takes a few passes instead of hundreds,
    over rows packed once into blocks; a pass has at most one task per core and brings features x features numbers from each.
    """
    from pyspark.ml.feature import VectorAssembler

    names = list(features)

    def packed(batches):
        for batch in batches:
            y, *x = [v.cast("double").to_numpy(zero_copy_only=False) for v in batch.columns]
            x, starts = np.column_stack(x), range(0, len(y), HINGE_ROWS)
            yield pa.RecordBatch.from_pydict({"x": [x[k:k + HINGE_ROWS].tobytes() for k in starts], "s": [(2 * y[k:k + HINGE_ROWS] - 1).tobytes() for k in starts]})

    few = df.select(label, *names).coalesce(df.sparkSession.sparkContext.defaultParallelism)
    blocks = few.mapInArrow(packed, "x binary, s binary").rdd.map(lambda r: (np.frombuffer(r["x"]).reshape(-1, len(names)), np.frombuffer(r["s"])))
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    left, bends = list(range(len(names))), BENDS
    try:
        if len(left) > keep:
            rows = VectorAssembler(inputCols=names, outputCol="_v").transform(few)
            model = C.LinearSVC(featuresCol="_v", labelCol=label, regParam=1.0 / (c * few.count()), standardization=False, maxIter=50).fit(rows)
            point = np.append(model.coefficients.toArray(), model.intercept)
        while len(left) > keep:
            point, bends = _hinge_weights(blocks, left, point, bends, c), BENDS[-1:]
            weakest = int(np.argmin(point[:-1] ** 2))
            left.pop(weakest)
            point = np.delete(point, weakest)
    finally:
        blocks.unpersist()
    return [names[i] for i in left]


class MeanVote:
    """Average of the class probabilities of several fitted models."""

    def __init__(self, models: Sequence, prediction: str = "prediction"):
        self.models, self.prediction = list(models), prediction

    def transform(self, df: DataFrame) -> DataFrame:
        out, names = df, df.columns
        for i, model in enumerate(self.models):
            scored = model.transform(out)
            out = scored.select(*names, *[f"_p{j}" for j in range(i)], vector_to_array("probability").alias(f"_p{i}"))
        total = F.col("_p0")
        for i in range(1, len(self.models)):
            total = F.zip_with(total, F.col(f"_p{i}"), lambda a, b: a + b)
        mean = F.transform(total, lambda v: v / len(self.models))
        out = out.select(*names, mean.alias("_m"))
        best = F.array_position("_m", F.array_max("_m")) - 1
        return out.select(*names, array_to_vector("_m").alias("probability"), best.cast("double").alias(self.prediction))


def bootstrap_weight(key: Column, replica: int, seed: int = 0) -> Column:
    """How often a row is drawn with replacement into a replica: Poisson with mean 1, from a hash of its key."""
    # 52 bits of the hash as a point of the unit interval, looked up in the distribution function; fixed until 1e-16 is left
    point = F.shiftrightunsigned(F.xxhash64(key, F.lit(replica), F.lit(seed)), 12) / float(1 << 52)
    below, term, cuts = 0.0, float(np.exp(-1.0)), []
    for times in range(1, 18):
        below += term
        term /= times
        cuts.append(below)
    return sum((point >= F.lit(c)).cast("int") for c in cuts).cast("double")


def bagging(df: DataFrame, make, replicas: int = 10, seed: int = 0, key: str | None = None) -> MeanVote:
    """Fit `make()` on samples drawn with replacement and average the probabilities.

    The draws depend on `key`, or on the whole row without one, so that reruns agree however the rows are partitioned. Estimators that
    take weights get them, others get each row as often as it is drawn.
    """
    drawn = F.col(key) if key else F.struct(*[F.unwrap_udt(c) if t.dataType.typeName() == "udt" else F.col(c) for c, t in zip(df.columns, df.schema)])
    models = []
    for i in range(replicas):
        model, rows = make(), df.withColumn("_times", bootstrap_weight(drawn, i, seed)).where("_times > 0")
        if model.hasParam("weightCol"):
            models.append(model.copy({model.getParam("weightCol"): "_times"}).fit(rows))
        else:
            models.append(model.fit(rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).drop("_copy", "_times")))
    return MeanVote(models)


def quadratic_discriminant(df: DataFrame, columns: Sequence[str], label: str) -> list[dict]:
    """Class priors, means and sample covariances from one grouped pass; k x k numbers per class come back."""
    k = len(columns)
    cells = [F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    found = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *cells).collect()
    total = sum(r["_n"] for r in found)
    model = []
    for r in sorted(found, key=lambda r: r[label]):
        spread = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        model.append({"label": r[label], "prior": float(np.log(r["_n"] / total)), "mean": [r[f"m{i}"] for i in range(k)],
                      "inverse": np.linalg.inv(spread), "logdet": float(np.linalg.slogdet(spread)[1])})
    return model


def discriminant_predict(df: DataFrame, model: list[dict], columns: Sequence[str], prediction: str = "prediction") -> DataFrame:
    """Class with the largest quadratic log density plus log prior."""
    scores = []
    for entry in model:
        gap = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, entry["mean"])]
        form = F.lit(0.0)
        for i, a in enumerate(gap):
            for j, b in enumerate(gap):
                form = form + a * b * F.lit(float(entry["inverse"][i, j]))
        score = F.lit(entry["prior"] - 0.5 * entry["logdet"]) - 0.5 * form
        scores.append(F.struct(score.alias("score"), F.lit(entry["label"]).alias("label")))
    return df.withColumn(prediction, F.array_max(F.array(*scores))["label"])


def fourier_features(df: DataFrame, features: str, output: str, gamma: float, count: int = 256, seed: int = 0) -> DataFrame:
    """Random cosine features whose inner products approximate exp(-gamma |a - b|^2) (Rahimi, Recht 2007)."""
    width = len(df.select(vector_to_array(features).alias("x")).first()["x"])
    draw = np.random.default_rng(seed)
    directions = draw.normal(scale=np.sqrt(2 * gamma), size=(width, count))
    phases = draw.uniform(0, 2 * np.pi, size=count)

    @F.pandas_udf("array<double>")
    def waves(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy())
        return pd.Series(list(np.sqrt(2.0 / count) * np.cos(x @ directions + phases)))

    return df.withColumn(output, array_to_vector(waves(vector_to_array(features))))


def signed_weights(coefficients: DataFrame, coef: str = "coef") -> DataFrame:
    """The rows with `side` and `weight` in place of the coefficient: its sign and its absolute value."""
    side = F.when(F.col(coef) >= 0, "positive").otherwise("negative")
    return coefficients.withColumns({"side": side, "weight": F.abs(coef)}).drop(coef)


def class_probability(column: str, k: int) -> Column:
    return vector_to_array(column)[k]
