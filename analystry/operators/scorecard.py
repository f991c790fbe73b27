"""How well a score separates two classes: KS, ROC, AUC, weight of evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from analystry.operators.ordering import average_rank, prefix_sum
from analystry.operators.quantiles import long_form, winsorize


def _label(column: Column) -> Column:
    """0/1 as long from a boolean or numeric label."""
    return column.cast("boolean").cast("long")


def _class_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    slim = df.select(*by, F.col(score).cast("double").alias("x"), _label(F.col(label)).alias("_y"))
    slim = slim.where(F.col("_y").isNotNull())
    return prefix_sum(slim, "x", {"n0": 1 - F.col("_y"), "n1": F.col("_y")}, by)


def _with_cdfs(counts: DataFrame) -> DataFrame:
    return (counts.withColumn("cdf0", F.try_divide(F.col("cum_n0"), F.col("tot_n0")))
            .withColumn("cdf1", F.try_divide(F.col("cum_n1"), F.col("tot_n1")))
            .withColumn("dist", F.abs(F.col("cdf0") - F.col("cdf1"))))


def ks_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., x, n, cdf0, cdf1, dist), one row per distinct score."""
    curve = _with_cdfs(_class_counts(df, score, label, by))
    return curve.select(*by, "x", (F.col("n0") + F.col("n1")).alias("n"), "cdf0", "cdf1", "dist")


def _ks_aggregates() -> list[Column]:
    rows = F.sum("n")
    ahead = F.sum(F.when(F.col("cdf0") > F.col("cdf1"), F.col("n")).otherwise(0))
    return [F.max("dist").alias("ks"), (F.sum(F.col("dist") * F.col("n")) / rows).alias("ks_mean"),
            (ahead / rows).alias("ks_stability")]


def _entropy(p: Column) -> Column:
    q = 1 - p
    return F.when((p > 0) & (p < 1), -(p * F.ln(p) + q * F.ln(q))).when(p.isNotNull(), F.lit(0.0))


def ks_stats(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """KS, mean distance, share of rows where class 0 leads, and the entropy of that share."""
    stats = ks_curve(df, score, label, by).groupBy(*by).agg(*_ks_aggregates())
    return stats.withColumn("ks_entropy", _entropy(F.col("ks_stability")))


def roc_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, fpr, tpr) for the rule score >= threshold, one row per distinct score."""
    c = _class_counts(df, score, label, by)
    return c.select(
        *by, F.col("x").alias("threshold"),
        F.try_divide(F.col("tot_n0") - F.col("cum_n0") + F.col("n0"), F.col("tot_n0")).alias("fpr"),
        F.try_divide(F.col("tot_n1") - F.col("cum_n1") + F.col("n1"), F.col("tot_n1")).alias("tpr"))


def _auc() -> Column:
    # a positive beats every negative below it and half of the tied ones
    wins = F.sum(F.col("n1") * (F.col("cum_n0") - F.col("n0") / 2))
    return F.try_divide(wins, F.max("tot_n0").cast("double") * F.max("tot_n1")).alias("auc")


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, ties counted half."""
    return _class_counts(df, score, label, by).groupBy(*by).agg(_auc())


def ks_roc_report(train: DataFrame, test: DataFrame, score: str, label: str) -> DataFrame:
    """One row: ks1, roc1 on train and ks2, roc2 on test."""
    both = (train.select(F.lit("train").alias("split"), score, label)
            .unionByName(test.select(F.lit("test").alias("split"), score, label)))
    curve = _with_cdfs(_class_counts(both, score, label, ["split"]))
    per_split = curve.groupBy("split").agg(F.max("dist").alias("ks"), _auc())
    pick = lambda split, name: F.max(F.when(F.col("split") == split, F.col(name)))
    return per_split.agg(
        pick("train", "ks").alias("ks1"), pick("train", "auc").alias("roc1"),
        pick("test", "ks").alias("ks2"), pick("test", "auc").alias("roc2"))


def weight_of_evidence(df: DataFrame, score: str, label: str, bins: int = 10, signed: bool = False,
                       by: Sequence[str] = ()) -> DataFrame:
    """Odds, weight of evidence and information value per rank bucket 0 ... bins.

    The bucket is round-half-even(bins * average rank / n). By default the information value takes
    the absolute share difference, so it keeps the sign of the weight; `signed=True` gives the
    textbook, never negative form. A bucket without negatives has null odds.
    """
    y = _label(F.col(label))
    slim = df.select(*by, F.col(score).cast("double").alias("x"), y.alias("_y")).where(F.col("_y").isNotNull())
    ranked = prefix_sum(slim, "x", {"n": F.lit(1), "n1": F.col("_y")}, by)
    mean_rank = F.col("cum_n") - (F.col("n") - 1) / 2
    bucket = F.bround(mean_rank / F.col("tot_n") * bins, 0).cast("int")
    counts = ranked.groupBy(*by, bucket.alias("bucket")).agg(
        F.sum("n1").alias("y"), F.sum(F.col("n") - F.col("n1")).alias("noty"))
    group = Window.partitionBy(*by)  # at most bins + 1 rows per group
    shares = (counts.withColumn("pery", F.try_divide(F.col("y"), F.sum("y").over(group)))
              .withColumn("pernoty", F.try_divide(F.col("noty"), F.sum("noty").over(group)))
              .withColumn("odds", F.try_divide(F.col("pery"), F.col("pernoty")))
              .withColumn("woe", F.ln("odds")))
    difference = F.col("pery") - F.col("pernoty")
    return shares.withColumn("iv", F.col("woe") * (difference if signed else F.abs(difference)))


def ks_panel(df: DataFrame, features: Sequence[str], target: str, classes: Sequence) -> DataFrame:
    """KS and AUC of every feature against every class, one against the rest.

    Class counts are columns of one running sum per feature, so rows are not repeated per class.
    """
    long = long_form(df, features, [target])
    flags = {f"c{i}": (F.col(target) == k).cast("long") for i, k in enumerate(classes)}
    running = prefix_sum(long, "x", {"n": F.lit(1), **flags}, ["feature"])
    per_class = running.select("feature", "x", F.explode(F.array(*[
        F.struct(
            F.lit(k).alias("class"), F.col(f"c{i}").alias("n1"), F.col(f"cum_c{i}").alias("cum_n1"),
            F.col(f"tot_c{i}").alias("tot_n1"), (F.col("n") - F.col(f"c{i}")).alias("n0"),
            (F.col("cum_n") - F.col(f"cum_c{i}")).alias("cum_n0"),
            (F.col("tot_n") - F.col(f"tot_c{i}")).alias("tot_n0"))
        for i, k in enumerate(classes)])).alias("_c")).select("feature", "x", "_c.*")
    return _with_cdfs(per_class).groupBy("feature", "class").agg(F.max("dist").alias("ks"), _auc())


def ks_histogram_report(df: DataFrame, score: str, label: str, cutoff: float = 0.025) -> DataFrame:
    """KS statistics of the score clipped to its own cutoff and 1 - cutoff quantiles."""
    clipped = winsorize(df.select(score, label), {score: (cutoff, 1 - cutoff)})
    return ks_stats(clipped, score, label)


__all__ = ["average_rank", "auc", "ks_curve", "ks_histogram_report", "ks_panel", "ks_roc_report", "ks_stats",
           "roc_curve", "weight_of_evidence"]
