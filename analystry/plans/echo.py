"""Learn to repeat a series some steps later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from analystry.operators.ordering import ordered_index, shift
from analystry.operators.statistics import log_loss


def lagged(df: DataFrame, value: str, order: Sequence[str], steps: int = 15, echo: int = 3) -> DataFrame:
    """(idx, features, label): the last `steps` values, newest first, and the value `echo` rows back.

    Each row sends its value to the rows that need it, so one shuffle builds every window.
    """
    indexed = ordered_index(df, order, name="idx", total="_n")
    sent = indexed.select(F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("lag"), "idx", "_n", F.col(value).alias("x"))
    sent = sent.select((F.col("idx") + F.col("lag")).alias("idx"), "lag", "x", "_n").where(F.col("idx") < F.col("_n"))
    cells = sent.groupBy("idx").agg(*[
        F.coalesce(F.max(F.when(F.col("lag") == i, F.col("x"))), F.lit(0)).cast("double").alias(f"l{i}") for i in range(steps)])
    return cells.select("idx", array_to_vector(F.array(*[f"l{i}" for i in range(steps)])).alias("features"),
                        F.col(f"l{echo}").cast("int").alias("label"))


def echo_report(df: DataFrame, value: str, order: Sequence[str], steps: int = 15, echo: int = 3) -> DataFrame:
    """(accuracy, log_loss) of a logistic model that sees the window and predicts the echo."""
    rows = lagged(df, value, order, steps, echo)
    scored = LogisticRegression(maxIter=50, regParam=1e-4).fit(rows).transform(rows)
    flat = scored.select("label", (F.col("prediction") == F.col("label")).cast("int").alias("hit"),
                         vector_to_array("probability")[1].alias("p1"))
    from analystry.functions.numeric import log_loss_term
    p = F.when(F.col("label") == 1, F.col("p1")).otherwise(1 - F.col("p1"))
    return flat.agg(F.avg("hit").alias("accuracy"), F.avg(log_loss_term(p)).alias("log_loss"))


__all__ = ["echo_report", "lagged", "log_loss", "shift"]
