"""Numeric column functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def quadrant(x: Column, y: Column, x_cut: Column, y_cut: Column) -> Column:
    """gray / green on the low side of x, orange / red on the high side; the second of each is high y."""
    return (F.when((x < x_cut) & (y < y_cut), "gray").when(x < x_cut, "green")
            .when(y < y_cut, "orange").otherwise("red"))


def geometric_mean(columns: Sequence[Column]) -> Column:
    return F.pow(reduce(lambda a, b: a * b, columns), F.lit(1.0 / len(columns)))


def rank_score(columns: Sequence[Column], groups: int) -> Column:
    """ceil(groups * geometric mean of rank shares), at least 1.

    The product is rounded to nine places first, so that the last bit of a power cannot lift a
    whole number into the next group.
    """
    return F.greatest(F.ceil(F.round(F.lit(groups) * geometric_mean(columns), 9)), F.lit(1)).cast("int")


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two array<double> columns."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def two_class_argmax(p0: Column) -> Column:
    """1 when class 0 has less than half of the probability."""
    return F.when(p0 < 0.5, 1).otherwise(0)


def log_loss_term(p_true: Column, floor: float = 1e-15) -> Column:
    """-ln of the probability given to the true class."""
    return -F.ln(F.greatest(p_true, F.lit(floor)))
