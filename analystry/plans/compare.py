"""Fit several classifiers on the same rows and compare accuracy and time."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from analystry.operators.statistics import relative_times
from analystry.sources.generated import mesh


def compare(train: DataFrame, test: DataFrame, makers: Mapping[str, Callable[[DataFrame], object]],
            label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(name, accuracy, train_seconds, test_seconds and their shares of the slowest).

    Each maker takes the training rows and returns something with `transform`.
    """
    results = []
    for name, make in makers.items():
        start = time.time()
        model = make(train)
        trained = time.time()
        hit = (F.col(prediction) == F.col(label)).cast("int")
        score = model.transform(test).agg(F.avg(hit)).first()[0]
        results.append((name, score, trained - start, time.time() - trained))
    spark = train.sparkSession
    table = spark.createDataFrame(results, "name string, accuracy double, train_seconds double, test_seconds double")
    return relative_times(table)


def decision_surface(model, points: DataFrame, x: str, y: str, step: float = 0.02, features: str = "features") -> DataFrame:
    """(x, y, prediction) on a mesh over the extent of two columns."""
    from pyspark.ml.feature import VectorAssembler

    grid = mesh(points, x, y, step)
    return model.transform(VectorAssembler(inputCols=["x", "y"], outputCol=features).transform(grid)).select("x", "y", "prediction")
