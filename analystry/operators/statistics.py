"""Correlation, histograms, density, covariance, classification quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from analystry.operators.ordering import is_number, prefix_sum
from analystry.operators.quantiles import long_form, scalars


def _pearson(a: str, b: str) -> Column:
    """Null when either side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def corr_with_target(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, r, abs_r) of every feature with a numeric target, strongest first."""
    typed = df.withColumn("_y", F.col(target).cast("double"))
    found = long_form(typed, features, ["_y"]).groupBy("feature").agg(_pearson("x", "_y").alias("r"))
    return found.withColumn("abs_r", F.abs("r")).orderBy(F.desc_nulls_last("abs_r"), "feature")


def array_corr_with_target(df: DataFrame, values: str, target: str) -> DataFrame:
    """(pos, r, abs_r) for every element of an array column."""
    long = df.select(F.col(target).cast("double").alias("_y"), F.posexplode(values).alias("pos", "x"))
    found = long.groupBy("pos").agg(_pearson("x", "_y").alias("r"))
    return found.withColumn("abs_r", F.abs("r"))


def most_correlated(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """The feature with the largest |r|; constant features never win."""
    ranked = corr_with_target(df, features, target).where(F.col("abs_r").isNotNull())
    return ranked.agg(F.max_by("feature", F.struct("abs_r", "feature")).alias("feature"), F.max("abs_r").alias("abs_r"))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r, abs_r) for every ordered pair of columns, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    sums = df.agg(*[_pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a in columns:
        for b in columns:
            name = f"{a}|{b}" if (a, b) in pairs else f"{b}|{a}"
            r = F.lit(1.0) if a == b else F.col(f"`{name}`")
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")))
    long = sums.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    return long.withColumn("abs_r", F.abs("r"))


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = (), own_range: bool = False) -> DataFrame:
    """(by..., bin, lo, hi, n) for equal-width bins; the last bin is closed, empty bins are left out.

    The range is that of the whole column, or of each by-group with own_range. A constant column
    gets the range value - 0.5 ... value + 0.5.
    """
    x = F.col(column).cast("double")
    slim = df.where(is_number(F.col(column))).select(*by, x.alias("_x"))
    # equal values first become one row with a count, so a hot value costs nothing further on
    merged = slim.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n"))
    ends = [F.min("_x").alias("_a"), F.max("_x").alias("_b")]
    if own_range and by:
        placed = merged.join(slim.groupBy(*by).agg(*ends), list(by))
    else:
        s = scalars(slim.agg(*ends))
        placed = merged.select("*", s["_a"].alias("_a"), s["_b"].alias("_b"))
    flat = F.col("_a") == F.col("_b")
    placed = (placed.withColumn("_lo", F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")))
              .withColumn("_hi", F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")))
              .withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
              .withColumn("bin", F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")))
    counted = placed.groupBy(*by, "bin").agg(F.sum("_n").alias("n"), F.first("_lo").alias("_lo"), F.first("_w").alias("_w"))
    return counted.select(
        *by, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lo"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("hi"), "n")


def kde(df: DataFrame, column: str, points: int = 50, cut: float = 3.0) -> DataFrame:
    """(g, density): Gaussian kernel density on an even grid with Scott's bandwidth.

    Equal values are merged first; partial aggregation then leaves `points` rows per task.
    """
    x = F.col(column).cast("double")
    slim = df.where(is_number(F.col(column))).select(x.alias("_x"))
    s = scalars(slim.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count(F.lit(1)).alias("n"),
                         F.stddev_samp("_x").alias("sd")))
    width = s["sd"] * F.pow(s["n"].cast("double"), F.lit(-0.2))
    merged = slim.groupBy("_x").agg(F.count(F.lit(1)).alias("_n"))
    spread = merged.select(
        "_x", "_n", width.alias("_h"), (s["lo"] - cut * width).alias("_from"),
        ((s["hi"] - s["lo"] + 2 * cut * width) / (points - 1)).alias("_step"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    g = F.col("_from") + F.col("i") * F.col("_step")
    z = (g - F.col("_x")) / F.col("_h")
    weight = F.col("_n") * F.exp(-0.5 * z * z) / (F.col("_h") * F.sqrt(F.lit(2 * np.pi)))
    return spread.groupBy("i").agg(F.first(g).alias("g"), (F.sum(weight) / F.sum("_n")).alias("density"))


def kde2d(df: DataFrame, x: str, y: str, points: int = 15) -> DataFrame:
    """(i, j, gx, gy, density): product kernel on a grid between the extremes, Scott's bandwidth per axis."""
    slim = df.where(is_number(F.col(x)) & is_number(F.col(y))).select(
        F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    s = scalars(slim.agg(
        F.min("_x").alias("xl"), F.max("_x").alias("xh"), F.stddev_samp("_x").alias("xs"),
        F.min("_y").alias("yl"), F.max("_y").alias("yh"), F.stddev_samp("_y").alias("ys"), F.count(F.lit(1)).alias("n")))
    shrink = F.pow(s["n"].cast("double"), F.lit(-1.0 / 6))
    merged = slim.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    placed = merged.select(
        "_x", "_y", "_n", (s["xs"] * shrink).alias("_hx"), (s["ys"] * shrink).alias("_hy"), s["xl"].alias("_xl"),
        s["yl"].alias("_yl"), ((s["xh"] - s["xl"]) / (points - 1)).alias("_dx"),
        ((s["yh"] - s["yl"]) / (points - 1)).alias("_dy"), F.explode(steps).alias("i"))
    placed = placed.select("*", F.explode(steps).alias("j"))
    gx, gy = F.col("_xl") + F.col("i") * F.col("_dx"), F.col("_yl") + F.col("j") * F.col("_dy")
    zx, zy = (gx - F.col("_x")) / F.col("_hx"), (gy - F.col("_y")) / F.col("_hy")
    weight = F.col("_n") * F.exp(-0.5 * (zx * zx + zy * zy)) / (2 * np.pi * F.col("_hx") * F.col("_hy"))
    return placed.groupBy("i", "j").agg(
        F.first(gx).alias("gx"), F.first(gy).alias("gy"), (F.sum(weight) / F.sum("_n")).alias("density"))


def limits(df: DataFrame, columns: Sequence[str], share: float = 0.05, margin: float = 0.0) -> DataFrame:
    """(feature, low, high): min and max widened by a share of the range plus a margin."""
    kept = long_form(df, columns).where(is_number(F.col("x")))
    ends = kept.groupBy("feature").agg(F.min("x").alias("_a"), F.max("x").alias("_b"))
    pad = (F.col("_b") - F.col("_a")) * share + margin
    return ends.select("feature", (F.col("_a") - pad).alias("low"), (F.col("_b") + pad).alias("high"))


def covariance(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Sample covariance; only the k x k numbers reach the driver."""
    k = len(columns)
    cells = [F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    row = df.agg(*cells).first()
    matrix = np.empty((k, k))
    for i in range(k):
        for j in range(i, k):
            matrix[i, j] = matrix[j, i] = row[f"c{i}_{j}"]
    return matrix


def mahalanobis(df: DataFrame, columns: Sequence[str], name: str = "distance") -> DataFrame:
    """Distance of every row from the mean under the inverse sample covariance."""
    inverse = np.linalg.inv(covariance(df, columns))
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centred = [F.col(c) - F.lit(float(means[c])) for c in columns]
    total = F.lit(0.0)
    for i, a in enumerate(centred):
        for j, b in enumerate(centred):
            total = total + a * b * F.lit(float(inverse[i, j]))
    return df.withColumn(name, F.sqrt(F.greatest(total, F.lit(0.0))))


def cum_share(df: DataFrame, column: str, cut: float = 0.2) -> DataFrame:
    """percent = whole percent of rows whose running total, in ascending order, is below cut of the sum.

    For values that are not negative. Rows with equal values are counted by arithmetic, not one by one.
    """
    x = F.col(column).cast("double")
    runs = prefix_sum(df.select(x.alias("_x")), "_x", {"n": F.lit(1), "s": F.col("_x")})
    room = F.lit(cut) * F.col("tot_s") - (F.col("cum_s") - F.col("s"))
    below = F.when(F.col("_x") > 0, F.least(F.greatest(F.ceil(room / F.col("_x")) - 1, F.lit(0)), F.col("n")))
    below = below.otherwise(F.when(room > 0, F.col("n")).otherwise(0))
    return runs.agg(F.floor(F.sum(below) / F.max("tot_n") * 100).cast("int").alias("percent"))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: hits, n, accuracy."""
    hit = F.col(truth).eqNullSafe(F.col(predicted)).cast("int")
    return df.agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) in long form."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support) per class, then macro and weighted averages."""
    cells = confusion(df, truth, predicted)
    sides = cells.select(
        F.explode(F.array(
            F.struct(F.col("truth").cast("string").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("named"),
                     F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")),
            F.struct(F.col("predicted").cast("string").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("named"),
                     F.lit(0).cast("long").alias("hits")))).alias("_s")).select("_s.*")
    per = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("named").alias("named"), F.sum("hits").alias("hits"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    per = per.select("class", ratio("hits", "named").alias("precision"), ratio("hits", "support").alias("recall"), "support")
    per = per.withColumn("f1", F.coalesce(F.try_divide(
        2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    measures = ["precision", "recall", "f1"]
    macro = per.agg(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support"))
    weighted = per.agg(
        F.lit("weighted avg").alias("class"),
        *[F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"))
    order = ["class", *measures, "support"]
    return per.select(*order).unionByName(macro.select(*order)).unionByName(weighted.select(*order))


def log_loss(df: DataFrame, truth: str, p1: str) -> DataFrame:
    """Mean -ln of the probability given to the true one of two classes."""
    from analystry.functions.numeric import log_loss_term

    p = F.when(F.col(truth).cast("int") == 1, F.col(p1)).otherwise(1 - F.col(p1))
    return df.agg(F.avg(log_loss_term(p)).alias("log_loss"))


def coefficient_density(weights: DataFrame, weight: str = "coef") -> DataFrame:
    """One row: dimensionality and the share of non-zero coefficients."""
    return weights.agg(F.count(F.lit(1)).alias("dimensionality"),
                       F.avg((F.col(weight) != 0).cast("int")).alias("density"))


def relative_times(results: DataFrame, columns: Sequence[str] = ("train_seconds", "test_seconds")) -> DataFrame:
    """Divide each time by the largest of its column; the table has one row per compared model."""
    everything = Window.partitionBy()
    return results.withColumns({f"{c}_share": F.try_divide(F.col(c), F.max(c).over(everything)) for c in columns})
