"""Where the registry modules enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its SQL if there is one."""

    def enter(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return enter


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round double columns, so that summation order cannot show in the comparison."""
    from pyspark.sql import functions as F

    return df.select(*[
        F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
