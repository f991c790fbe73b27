"""Points of interest: score rows on several variables and relate the score to an impact size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from analystry.functions.numeric import rank_score
from analystry.operators.columns import fill_missing
from analystry.operators.ordering import ordered_index
from analystry.operators.quantiles import long_form, quantile_filter, scalars
from analystry.operators.statistics import mahalanobis

METHODS = ("Rank", "Mahalanobis", "KMeans", "Hierarchical")


def rank_shares(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """df plus `<column>_pos` and `_n`: 0-based position of every column's value, ties by key.

    All columns are ranked in one pass over (column, value, key) rows.
    """
    long = long_form(df, columns, [key])
    placed = ordered_index(long, ["x", key], ["feature"], name="_i", total="_n")
    wide = placed.groupBy(key).agg(
        F.max("_n").alias("_n"), *[F.max(F.when(F.col("feature") == c, F.col("_i"))).alias(f"{c}_pos") for c in columns])
    return df.join(wide, key)


def scored_rows(df: DataFrame, key: str, variables: Sequence[str], size: str, mass: float = 0.0, groups: int = 10,
                score_groups: int = 10, method: str = "Rank") -> DataFrame:
    """(key, size, variables, <v>_share, score, fin) of the rows whose size reaches the mass quantile.

    `fin` is the size's rank bin 1 ... groups. Missing variables count as 0.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    kept = quantile_filter(df.select(key, size, *variables), size, mass, "ge")
    kept = fill_missing(kept.withColumns({v: F.col(v).cast("double") for v in variables}), variables)
    ranked = rank_shares(kept, key, [*variables, size])
    shares = [f"{v}_share" for v in variables]
    ranked = ranked.withColumns({f"{v}_share": F.col(f"{v}_pos") / F.col("_n") for v in variables})
    fin = F.floor((F.lit(groups) * (F.col(f"{size}_pos") + 1) + F.col("_n") - 1) / F.col("_n")).cast("int")
    ranked = ranked.select(key, size, *variables, *shares, fin.alias("fin"))
    if method == "Rank":
        return ranked.withColumn("score", rank_score([F.col(s) for s in shares], score_groups))
    if method == "Mahalanobis":
        away = mahalanobis(ranked, shares, "_d")
        ends = scalars(away.agg(F.min("_d").alias("lo"), F.max("_d").alias("hi")))
        scaled = F.try_divide(F.col("_d") - ends["lo"], ends["hi"] - ends["lo"])
        return away.withColumn("score", F.ceil(F.round(scaled * score_groups, 9)).cast("int")).drop("_d")
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.feature import VectorAssembler
    points = VectorAssembler(inputCols=shares, outputCol="_v").transform(ranked)
    maker = KMeans if method == "KMeans" else BisectingKMeans  # the latter splits from the top down
    model = maker(k=score_groups, seed=0, featuresCol="_v", predictionCol="score").fit(points)
    return model.transform(points).drop("_v")


def _score_values(method: str, score_groups: int) -> list[int]:
    return list(range(1, score_groups + 1)) if method == "Rank" else list(range(0, score_groups + 1))


def count_report(scored: DataFrame, score_groups: int = 10, method: str = "Rank") -> DataFrame:
    """fin x score counts."""
    table = scored.groupBy("fin").pivot("score", _score_values(method, score_groups)).agg(F.count(F.lit(1)))
    return table.na.fill(0)


def impact_report(scored: DataFrame, size: str) -> DataFrame:
    """(fin, n, total): size summed per impact bin."""
    return scored.groupBy("fin").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"))


def mean_report(scored: DataFrame, variable: str, score_groups: int = 10, method: str = "Rank") -> DataFrame:
    """fin x score means of one variable."""
    return scored.groupBy("fin").pivot("score", _score_values(method, score_groups)).agg(F.avg(variable))


def projection(scored: DataFrame, key: str, variables: Sequence[str]) -> DataFrame:
    """(key, c0, c1, score): rank shares, projected on two principal components if there are more than two."""
    from pyspark.ml.functions import vector_to_array

    from analystry.operators.models import centred_pca
    shares = [f"{v}_share" for v in variables]
    if len(shares) <= 2:
        return scored.select(key, *[F.col(s).alias(f"c{i}") for i, s in enumerate(shares)], "score")
    from pyspark.ml.feature import VectorAssembler
    points = VectorAssembler(inputCols=shares, outputCol="_v").transform(scored)
    _, placed = centred_pca(points, "_v", "_p", components=2)
    values = vector_to_array("_p")
    return placed.select(key, values[0].alias("c0"), values[1].alias("c1"), "score")
