"""Song list: clean the fields, then total by artist or genre."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from analystry.functions import text as T


def clean_songs(df: DataFrame, short_genre: int = 2) -> DataFrame:
    """Trim contributors, read the first exhibition count as a number, name short genres unknown."""
    return df.withColumns({
        "contributor": T.strip_spaces(F.col("contributor")),
        "exbibitions": T.first_number(F.col("exbibitions")),
        "genre": T.unknown_if_short(F.col("genre"), short_genre)})


def top_by_total(df: DataFrame, key: str, value: str, n: int, total: str = "total", places: int = 2) -> DataFrame:
    """The n keys with the largest sum; missing keys and values are left out, ties go by key."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.round(F.coalesce(F.sum(F.nanvl(F.col(value), F.lit(None).cast("double"))), F.lit(0.0)), places).alias(total))
    return counted.orderBy(F.desc(total), key).limit(n)
