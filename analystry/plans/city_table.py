"""Stored state pages -> one typed table of cities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from analystry.functions import text as T
from analystry.operators.columns import cast_with_rejects
from analystry.sources.html import html_table

# The columns of the published table.
CITY_COLUMNS = ["cidade", "codigoIBGE", "gentilico", "populacao", "area", "densidadeDemografica", "pib"]
WRITTEN_AS_NUMBERS = ["populacao", "area", "densidadeDemografica", "pib"]


def city_rows(pages: DataFrame, content: str = "content") -> DataFrame:
    """All-text rows with state and region; incomplete rows are dropped.

    Only the number columns lose their thousands points, so names keep theirs.
    """
    cells = html_table(pages, content, CITY_COLUMNS, keep=["state", "region"]).drop("row_no")
    cells = cells.withColumns({c: T.brazilian_number(F.col(c)) for c in WRITTEN_AS_NUMBERS})
    return cells.select(*CITY_COLUMNS, "state", "region").na.drop("any")


def city_table(pages: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(typed rows, rows whose numbers cannot be read)."""
    return cast_with_rejects(city_rows(pages, content), {"populacao": "int", "pib": "float"})
