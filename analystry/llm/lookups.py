"""Choosing between a broadcast and a shuffle by the counted size of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of two or three numbers that are broadcast at most; above this the join shuffles.
LOOKUP_ROWS = 1 << 18


def small_side(rows: DataFrame, most: int = LOOKUP_ROWS) -> DataFrame:
    """The table, marked for broadcast if it has been counted to hold at most `most` rows. Its rows must be narrow."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
