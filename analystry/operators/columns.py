"""Choosing, dropping, typing and filling columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop columns whose name matches the pattern from its start."""
    return df.drop(*[c for c in df.columns if re.match(pattern, c)])


def drop_containing(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Drop columns whose name holds any of the parts."""
    return df.drop(*[c for c in df.columns if any(p in c for p in parts)])


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns in alphabetical order."""
    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType))


def is_missing(df: DataFrame, name: str) -> Column:
    missing = F.col(name).isNull()
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(name)
    return missing


def null_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: share of missing values per column, from a single pass."""
    return df.agg(*[F.avg(is_missing(df, c).cast("int")).alias(c) for c in columns or df.columns])


def drop_null_columns(df: DataFrame, columns: Sequence[str] | None = None, max_null_ratio: float = 0.0) -> DataFrame:
    """Drop the listed (default: numeric) columns with more missing values than allowed."""
    listed = list(columns or numeric_columns(df))
    ratios = null_ratios(df, listed).first().asDict() if listed else {}
    return df.drop(*[c for c, r in ratios.items() if r is not None and r > max_null_ratio])


def profile(df: DataFrame) -> DataFrame:
    """(column, type, rows, non_null) per column, from a single pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                    *[F.count(F.when(~is_missing(df, c), 1)).alias(c) for c in df.columns])
    cells = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("_rows").alias("rows"),
                      F.col(c).alias("non_null")) for c, t in df.dtypes]
    return counts.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def cast_with_rejects(df: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows): a row is rejected when a given text cannot be cast."""
    bad = F.lit(False)
    for c, kind in kinds.items():
        bad = bad | (F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull())
    typed = df.where(~bad).withColumns({c: F.col(c).try_cast(kind) for c, kind in kinds.items()})
    return typed, df.where(bad)


def not_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Rows different from value; rows without a value count as different."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def in_categories(df: DataFrame, column: str, categories: Sequence | None) -> DataFrame:
    """Rows of the listed categories, or all rows for None."""
    return df if categories is None else df.where(F.col(column).isin(list(categories)))


def with_constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def fill_missing(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.na.fill(value, list(columns))
