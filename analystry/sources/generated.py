"""Grids over the extent of a table, and labelled toy shapes laid over its rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from analystry.operators.ordering import ordered_index
from analystry.operators.quantiles import scalars


def _extent(points: DataFrame, x: str, y: str):
    return points.agg(F.min(x).cast("double"), F.max(x).cast("double"), F.min(y).cast("double"), F.max(y).cast("double")).first()


def _cells(points: DataFrame, rows: int, columns: int) -> DataFrame:
    """(i, j) of a rows x columns grid, made where they are used: each task counts off its own stretch."""
    number = F.col("id")
    return points.sparkSession.range(rows * columns).select(F.floor(number / columns).cast("int").alias("i"), F.pmod(number, F.lit(columns)).cast("int").alias("j"))


def grid2d(points: DataFrame, x: str, y: str, steps: int, pad: float = 0.05) -> DataFrame:
    """(cell, i, j, x, y): even steps x steps mesh over the extent of two columns, padded."""
    xl, xh, yl, yh = _extent(points, x, y)

    def at(low: float | None, high: float | None, index: str) -> Column:
        low, high = F.lit(low).cast("double"), F.lit(high).cast("double")
        reach = (high - low) * pad
        return (low - reach) + F.col(index) * (high - low + 2 * reach) / (steps - 1)

    return _cells(points, steps, steps).select(
        (F.col("i").cast("long") * steps + F.col("j")).alias("cell"), "i", "j", at(xl, xh, "i").alias("x"), at(yl, yh, "j").alias("y"))


def mesh(points: DataFrame, x: str, y: str, step: float, margin: float = 0.5) -> DataFrame:
    """(x, y) at a fixed step from min - margin up to, not including, max + margin."""
    xl, xh, yl, yh = _extent(points, x, y)
    rows, columns = (0 if low is None else math.ceil((high - low + 2 * margin) / step) for low, high in ((xl, xh), (yl, yh)))
    cells = _cells(points, rows, max(columns, 1))
    return cells.select((F.lit(xl).cast("double") - margin + F.col("i") * step).alias("x"), (F.lit(yl).cast("double") - margin + F.col("j") * step).alias("y"))


def moons(rows: DataFrame, key: str, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(key, x, y, label): two interleaving half circles laid over the rows in key order."""
    placed = ordered_index(rows.select(key), [key], name="_i", total="_n")
    outer = F.floor(F.col("_n") / 2)
    in_outer = F.col("_i") < outer
    step = F.when(in_outer, F.col("_i") / F.greatest(outer - 1, F.lit(1))).otherwise(
        (F.col("_i") - outer) / F.greatest(F.col("_n") - outer - 1, F.lit(1)))
    angle = step * math.pi
    x = F.when(in_outer, F.cos(angle)).otherwise(1 - F.cos(angle))
    y = F.when(in_outer, F.sin(angle)).otherwise(0.5 - F.sin(angle))
    return _noisy(placed.select(key, x.alias("x"), y.alias("y"), F.when(in_outer, 0).otherwise(1).alias("label")), noise, seed)


def circles(rows: DataFrame, key: str, factor: float = 0.5, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(key, x, y, label): a circle and a smaller one inside it."""
    placed = ordered_index(rows.select(key), [key], name="_i", total="_n")
    outer = F.floor(F.col("_n") / 2)
    in_outer = F.col("_i") < outer
    turn = F.when(in_outer, F.col("_i") / outer).otherwise((F.col("_i") - outer) / (F.col("_n") - outer)) * (2 * math.pi)
    radius = F.when(in_outer, 1.0).otherwise(factor)
    return _noisy(placed.select(key, (radius * F.cos(turn)).alias("x"), (radius * F.sin(turn)).alias("y"),
                                F.when(in_outer, 0).otherwise(1).alias("label")), noise, seed)


def blobs(rows: DataFrame, key: str, noise: float = 1.0, shift: float = 0.0, seed: int = 0) -> DataFrame:
    """(key, x, y, label): one cloud per class, with an optional uniform shift of every coordinate."""
    label = F.when(_uniform(key, seed) < 0.5, 0).otherwise(1)
    centre = F.when(label == 1, 1.0).otherwise(-1.0)
    out = _noisy(rows.select(key, centre.alias("x"), centre.alias("y"), label.alias("label")), noise, seed)
    if not shift:
        return out
    return out.withColumns({"x": F.col("x") + shift * _uniform(key, seed + 3), "y": F.col("y") + shift * _uniform(key, seed + 4)})


def echo_series(rows: DataFrame, key: str, echo: int = 3, seed: int = 0) -> DataFrame:
    """(key, x, y): random bits over the rows and the same bits `echo` rows later, zero before."""
    from analystry.operators.ordering import shift

    bits = rows.select(key, F.when(_uniform(key, seed) < 0.5, 0).otherwise(1).alias("x"))
    return shift(bits, "x", [key], echo, "y")


def _uniform(key: str, seed: int) -> Column:
    """A number in (0, 1) that depends on key and seed only, so a recomputed task gets the same one: ten digits of an md5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 10)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / 2 ** 40


def _noisy(df: DataFrame, noise: float, seed: int) -> DataFrame:
    if not noise:
        return df
    key = df.columns[0]
    radius = F.sqrt(-2 * F.ln(_uniform(key, seed + 1)))
    turn = 2 * math.pi * _uniform(key, seed + 2)
    return df.withColumns({"x": F.col("x") + noise * radius * F.cos(turn), "y": F.col("y") + noise * radius * F.sin(turn)})
