"""Two measures cut into quadrants, and the largest rows of the high-high one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from analystry.functions.numeric import quadrant
from analystry.operators.columns import fill_missing
from analystry.operators.quantiles import min_max_scale, quantile_filter, quantile_values


def quadrant_points(df: DataFrame, key: str, x: str, y: str, size: str | None = None, mass: float = 0.0,
                    x_cut: float = 0.5, y_cut: float = 0.5, x_range: tuple[float, float] = (0.01, 1.0),
                    y_range: tuple[float, float] = (0.01, 1.0)) -> DataFrame:
    """(key, x, y, z, colour): clipped measures, scaled size and quadrant.

    Rows need a size strictly above its mass quantile. The cut lines are quantiles of the kept,
    unclipped measures. Without a size every row is kept and z is 0.01.
    """
    kept = quantile_filter(df.select(key, x, y, size), size, mass, "gt") if size else df.select(key, x, y)
    kept = fill_missing(kept.withColumns({c: F.col(c).cast("double") for c in (x, y)}), [x, y])
    order = sorted({x_cut, y_cut, *x_range, *y_range})
    cuts = quantile_values(kept, [x, y], order)
    at = lambda c, p: cuts[f"{c}_q{order.index(p)}"]
    lines = (at(x, x_cut), at(y, y_cut))
    clipped = kept.withColumns({c: F.least(F.greatest(F.col(c), at(c, ends[0])), at(c, ends[1]))
                                for c, ends in ((x, x_range), (y, y_range))})
    clipped = min_max_scale(clipped, [size], "_scaled") if size else clipped.withColumn("z", F.lit(0.01))
    z = F.col(f"{size}_scaled") if size else F.col("z")
    colour = quadrant(F.col(x), F.col(y), *lines)
    return clipped.select(key, F.col(x).alias("x"), F.col(y).alias("y"), z.alias("z"), colour.alias("colour"))


def red_rows(df: DataFrame, points: DataFrame, key: str, size: str | None = None, n: int = 5) -> DataFrame:
    """The n largest original rows whose point is red."""
    red = df.join(points.where(F.col("colour") == "red").select(key), key, "left_semi")
    return (red.orderBy(F.desc(size), key) if size else red.orderBy(key)).limit(n)
