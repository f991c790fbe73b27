"""Exact interpolated quantiles, and the cuts, clips and summaries made from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from analystry.operators.ordering import is_number, prefix_sum, range_borders, range_count, with_range


def grouped_quantiles(df: DataFrame, column: str, probabilities: Sequence[float],
                      by: Sequence[str] = ()) -> DataFrame:
    """One row per by-group: q0, q1, ... = linearly interpolated quantiles, plus the row count n.

    Spark's `percentile` keeps every distinct value of a group in one task. Here the rows are only
    counted per value range; the two order statistics around each position are then looked for in
    the few ranges that hold them, so little of the column is ever shuffled or sorted.
    """
    by = list(by)
    typed = df.where(is_number(F.col(column))).select(*by, F.col(column).cast("double").alias("_x"))
    borders = range_borders(typed, ["_x"], max(64, range_count(df)))
    placed = with_range(typed, ["_x"], borders)
    counts = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_range", "_rows", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"),
                            F.sum("_rows").over(group).alias("n"))
    ends = []
    for p in probabilities:
        position = (F.col("n") - 1) * F.lit(float(p))
        ends += [F.floor(position), F.ceil(position)]
    holds = [(F.col("_off") <= e) & (e < F.col("_off") + F.col("_rows")) for e in ends]
    needed = offsets.where(reduce(lambda a, b: a | b, holds)).select(*by, "_range", "_off", "n")
    if not by:
        needed = F.broadcast(needed)  # at most one row per range
    merged = placed.join(needed, [*by, "_range"]).groupBy(*by, "_range", "_off", "n", "_x").agg(
        F.count(F.lit(1)).alias("_m"))
    inside = Window.partitionBy(*by, "_range").orderBy("_x")
    running = merged.select(*by, "n", "_x", (F.sum("_m").over(inside) + F.col("_off")).alias("_cum"), "_off")
    picks = []
    for i, p in enumerate(probabilities):
        position = (F.col("n") - 1) * F.lit(float(p))
        for name, end in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.min(F.when((F.col("_off") <= end) & (F.col("_cum") > end), F.col("_x"))).alias(f"_{name}{i}"))
    found = running.groupBy(*by).agg(F.max("n").alias("n"), *picks)
    out = []
    for i, p in enumerate(probabilities):
        position = (F.col("n") - 1) * F.lit(float(p))
        weight = position - F.floor(position)
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * weight).alias(f"q{i}"))
    return found.select(*by, "n", *out)


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, x): one row per listed column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "_p.x")


def column_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(feature, n, q0, q1, ...) for several columns in one pass."""
    return grouped_quantiles(long_form(df, columns), "x", probabilities, ["feature"])


def quantile_table(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """The same as a single row: column `<feature>_q<i>` per feature and probability."""
    long = column_quantiles(df, columns, probabilities)
    return long.agg(*[
        F.max(F.when(F.col("feature") == c, F.col(f"q{i}"))).alias(f"{c}_q{i}")
        for c in columns for i in range(len(probabilities))])


def scalars(one_row: DataFrame) -> Column:
    """A one-row frame as a scalar subquery; read its columns with `[...]`."""
    return one_row.select(F.struct("*").alias("_row")).scalar()


def quantile_values(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, Column]:
    """The same numbers as literals, so that cuts made from them reach the scan as plain filters.

    A few numbers per column are read back; what uses them does not compute them again.
    """
    row = quantile_table(df, columns, probabilities).first()
    return {name: F.lit(value).cast("double") for name, value in row.asDict().items()}


def quantile_filter(df: DataFrame, column: str, p: float, side: str = "le") -> DataFrame:
    """Keep rows on one side of the column's own quantile: le, lt, ge or gt."""
    cut = quantile_values(df, [column], [p])[f"{column}_q0"]
    value = F.col(column)
    tests = {"le": value <= cut, "lt": value < cut, "ge": value >= cut, "gt": value > cut}
    return df.where(is_number(value) & tests[side])


def winsorize(df: DataFrame, bounds: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """Clip each column to its own low and high quantile; missing values stay missing."""
    columns = list(bounds)
    ends = sorted({p for pair in bounds.values() for p in pair})
    cuts = quantile_values(df, columns, ends)
    for c in columns:
        low = cuts[f"{c}_q{ends.index(bounds[c][0])}"]
        high = cuts[f"{c}_q{ends.index(bounds[c][1])}"]
        clipped = F.when(is_number(F.col(c)), F.least(F.greatest(F.col(c).cast("double"), low), high))
        df = df.withColumn(c + suffix, clipped)
    return df


def box_summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers and outlier count, per by-group."""
    typed = df.select(*by, F.col(column).cast("double").alias("_x"))
    running = prefix_sum(typed, "_x", {"n": F.lit(1)}, by)
    quartiles = grouped_quantiles(df, column, [0.25, 0.5, 0.75], by)
    if by:
        joined = running.join(quartiles.drop("n"), list(by))
    else:
        cut = scalars(quartiles)
        joined = running.select("*", *[cut[f"q{i}"].alias(f"q{i}") for i in range(3)])
    spread = F.col("q2") - F.col("q0")
    low, high = F.col("q0") - 1.5 * spread, F.col("q2") + 1.5 * spread
    inside = (F.col("_x") >= low) & (F.col("_x") <= high)
    return joined.groupBy(*by).agg(
        F.sum("n").alias("n"), F.max("q0").alias("q1"), F.max("q1").alias("median"), F.max("q2").alias("q3"),
        F.min(F.when(F.col("_x") >= low, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(F.col("_x") <= high, F.col("_x"))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("outliers"))


def robust_scale(df: DataFrame, columns: Sequence[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(x - median) / (high quantile - low quantile); a zero spread divides by one."""
    cuts = quantile_values(df, columns, [low, 0.5, high])
    for c in columns:
        spread = cuts[f"{c}_q2"] - cuts[f"{c}_q0"]
        df = df.withColumn(c, (F.col(c).cast("double") - cuts[f"{c}_q1"])
                           / F.when(spread == 0, F.lit(1.0)).otherwise(spread))
    return df


def min_max_scale(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - min) / (max - min); null where the column is constant."""
    ends = scalars(df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"{c}_lo") for c in columns],
        *[F.max(F.col(c).cast("double")).alias(f"{c}_hi") for c in columns]))
    scaled = {c + suffix: F.try_divide(F.col(c).cast("double") - ends[f"{c}_lo"], ends[f"{c}_hi"] - ends[f"{c}_lo"])
              for c in columns}
    return df.withColumns(scaled)


def standard_scale(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population standard deviation; a constant column divides by one."""
    moments = scalars(df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns]))
    scaled = {}
    for c in columns:
        deviation = moments[f"{c}_std"]
        scaled[c + suffix] = (F.col(c) - moments[f"{c}_mean"]) / F.when(deviation == 0, F.lit(1.0)).otherwise(deviation)
    return df.withColumns(scaled)


def max_abs_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """x / max |x| per column."""
    ends = scalars(df.agg(*[F.max(F.abs(c)).alias(c) for c in columns]))
    return df.withColumns({c: F.coalesce(F.try_divide(F.col(c), ends[c]), F.lit(0.0)) for c in columns})
