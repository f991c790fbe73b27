"""Boosting of one-split trees from weighted histograms: one pass over packed rows a round, all features and classes together."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from analystry.operators.sparse_linear import Block, SparseRows

#: Equal bins in which a feature's rows are counted, and cuts between them that are tried, so that about as many rows lie between each two.
FINE, CUTS = 512, 64


@dataclass
class Stump:
    """Rows up to `cut` get class `low`, others `high`; the vote counts `alpha`."""

    feature: int
    cut: float
    low: int
    high: int
    alpha: float

    def votes(self, x: np.ndarray) -> np.ndarray:
        return np.where(x[:, self.feature] <= self.cut, self.low, self.high)


def _dense(block: Block, width: int) -> np.ndarray:
    x = np.zeros((len(block.label), width))
    x[block.row, block.index] = block.value
    return x


def _cuts(rows: SparseRows, least: np.ndarray, most: np.ndarray) -> list[np.ndarray]:
    """Per feature at most CUTS borders of its FINE bins; with few distinct values, one between each two."""
    width = rows.width
    span = np.where(most > least, most - least, 1.0)

    def counted(block: Block) -> np.ndarray:
        place = np.clip(((_dense(block, width) - least) / span * FINE).astype(int), 0, FINE - 1) + np.arange(width) * FINE
        return np.bincount(place.ravel(), np.repeat(block.weight, width), width * FINE)[:, None]

    counts = rows.swept(counted, width * FINE, 1).reshape(width, FINE)
    found = []
    for f in range(width):
        used = np.flatnonzero(counts[f])
        borders = (used[:-1] + used[1:] + 1) / 2  # between two bins that hold rows
        if len(borders) > CUTS:
            mass = np.cumsum(counts[f])[used[:-1]] / counts[f].sum()
            borders = borders[np.unique(np.searchsorted(mass, (np.arange(CUTS) + 1) / (CUTS + 1)).clip(0, len(borders) - 1))]
        found.append(least[f] + borders / FINE * span[f])
    return found


class BoostedStumps:
    """Weighted vote of one-split trees; the first of equal classes wins."""

    def __init__(self, stumps: list[Stump], classes: int, features: str, prediction: str):
        self.stumps, self.classes, self.features, self.prediction = stumps, classes, features, prediction

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), self.classes))
        for s in self.stumps:
            total[np.arange(len(x)), s.votes(x)] += s.alpha
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def winner(vectors: pd.Series) -> pd.Series:
            known = vectors.notna().to_numpy()
            out = np.full(len(vectors), None, dtype=object)
            if known.any():
                out[known] = self.scores(np.stack(vectors[known].to_numpy())).argmax(axis=1).astype(float)
            return pd.Series(out)

        return df.withColumn(self.prediction, winner(F.when(F.col(self.features).isNotNull(), vector_to_array(self.features))))


def ada_boost(df: DataFrame, classes: int, rounds: int = 50, features: str = "features", label: str = "label", prediction: str = "prediction") -> BoostedStumps:
    """SAMME (Zhu, Zou, Rosset, Hastie: Multi-class AdaBoost, 2009) of Gini splits.

    A round is one pass: tasks weigh their rows by the stumps so far and add up weights per feature, bin and class; features x bins x
    classes numbers come back. Ties go to the first feature and the lowest cut. Stops early when a stump is no better than chance or
    makes no mistake. Rows without label or vector are left out; without rows there are no stumps.
    """
    rows = SparseRows(df, features, label)
    width, stumps = rows.width, []
    if not rows.n or not width:
        return BoostedStumps([], classes, features, prediction)
    range_ = df.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(Summarizer.metrics("min", "max").summary(F.col(features)).alias("s")).select("s.*").first()
    cuts = _cuts(rows, range_["min"].toArray(), range_["max"].toArray())
    sizes = np.array([len(c) + 1 for c in cuts])
    first = np.cumsum(sizes) - sizes
    for _ in range(rounds):
        sent = rows.sent((cuts, list(stumps)))

        def histogram(block: Block) -> np.ndarray:
            borders, so_far = sent.value
            x, weight = _dense(block, width), block.weight.astype(float)
            raised = sum((s.alpha * (s.votes(x) != block.label) for s in so_far), np.zeros(len(x)))
            weight *= np.exp(raised - sum(s.alpha for s in so_far) / 2)  # the same factor for all rows, against overflow
            place = np.column_stack([np.searchsorted(b, x[:, f]) for f, b in enumerate(borders)]) + first
            cell = (place * classes + block.label[:, None]).ravel()
            return np.bincount(cell, np.repeat(weight, width), int(sizes.sum()) * classes).reshape(-1, classes)

        counts = rows.swept(histogram, int(sizes.sum()), classes)
        sent.destroy()
        best = None
        for f in range(width):
            own = counts[first[f]:first[f] + sizes[f]]
            total = own.sum(axis=0)
            low = np.cumsum(own, axis=0)[:-1]
            high = total - low
            a, b = low.sum(axis=1), high.sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                impurity = (a - (low ** 2).sum(axis=1) / a + b - (high ** 2).sum(axis=1) / b) / total.sum()
            impurity[~((a > 0) & (b > 0))] = np.inf
            if len(impurity):
                k = int(np.argmin(np.round(impurity, 12)))
                if np.isfinite(impurity[k]) and (best is None or round(impurity[k], 12) < best[0]):
                    best = (round(impurity[k], 12), f, k, low[k], high[k], total.sum())
        if best is None:
            break
        _, f, k, low, high, total = best
        error = 1 - (low.max() + high.max()) / total
        if error >= 1 - 1 / classes:
            break
        stumps.append(Stump(f, float(cuts[f][k]), int(low.argmax()), int(high.argmax()), float(np.log((1 - error) / max(error, 1e-12)) + np.log(classes - 1.0))))
        if error <= 1e-12:
            break
    return BoostedStumps(stumps, classes, features, prediction)
