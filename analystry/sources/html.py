"""HTML tables as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from analystry.functions import text as T


def html_table(df: DataFrame, html: str, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Cells of the first table body, one row per table row that has cells, as text columns.

    A short row has nulls at its end. Rows without cells and pages without a body give nothing.
    """
    body = T.drop_class_attribute(T.between_markers(T.drop_long_spaces(F.col(html)), "<tbody", "</tbody>"))
    lines = F.filter(F.split(body, "</tr>"), lambda r: F.contains(r, F.lit("<td>")))
    rows = df.select(*keep, F.posexplode(lines).alias("row_no", "_line"))
    cells = F.split(F.replace("_line", F.lit("</td>"), F.lit("")), "<td>")
    rows = rows.select(*keep, "row_no", cells.alias("_c"))
    return rows.select(*keep, "row_no", *[F.get("_c", i + 1).alias(n) for i, n in enumerate(names)])
