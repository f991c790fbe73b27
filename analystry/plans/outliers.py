"""Outlier score: how far a row lies from its nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from analystry.operators.neighbours import mean_neighbour_distance
from analystry.operators.quantiles import grouped_quantiles, min_max_scale, robust_scale, winsorize
from analystry.session import cut_lineage


def outlier_scores(df: DataFrame, key: str, columns: Sequence[str], neighbours: int = 49) -> DataFrame:
    """(key, loc): robust scaling, mean distance to the neighbours, clipped at 1 / 99 %, scaled to 0 ... 1."""
    scaled = robust_scale(df.select(key, *columns), columns)
    vectors = cut_lineage(scaled.select(F.col(key).cast("long").alias(key), F.array(*columns).alias("_v")))
    mean = mean_neighbour_distance(vectors, key, "_v", neighbours).withColumnRenamed("query_id", key)
    # the neighbour search is the costly part and is read several times from here on
    return min_max_scale(winsorize(cut_lineage(mean), {"loc": (0.01, 0.99)}), ["loc"])


def score_levels(scores: DataFrame, levels: int = 5, stretch: float = 1.1) -> DataFrame:
    """(level, value): evenly spaced quantiles of the stretched score."""
    steps = [i / (levels - 1) for i in range(levels)]
    cuts = grouped_quantiles(scores.select((F.col("loc") * stretch).alias("x")), "x", steps)
    return cuts.select(F.posexplode(F.array(*[f"q{i}" for i in range(levels)])).alias("level", "value"))
