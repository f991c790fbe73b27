"""Globally ordered computations without a single-task window.

A window ordered by x but partitioned by nothing moves every row into one task. The helpers here
cut the ordered key range into ranges of similar size, work inside each range, and add what lies
before the range. Running sums use borders that are plain values held in the plan; numbering range-partitions
the rows once and fixes the ranges by a reliable checkpoint. Either way, evaluating again after a lost
executor gives the same ranges; they steer balance only, never the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from analystry.session import cut_lineage

SAMPLE_PER_RANGE = 60
#: Rows of a block whose earlier values one task looks up.
SHIFT_BLOCK = 1 << 16
#: monotonically_increasing_id() holds the partition above this many bits and the place in it below.
PLACE_BITS = 33


def range_count(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def is_number(column: Column) -> Column:
    """Neither null nor NaN."""
    return column.isNotNull() & ~F.isnan(column.cast("double"))


def _drop_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    for name in names:
        kind = df.schema[name].dataType
        column = F.col(name)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            df = df.where(is_number(column))
        else:
            df = df.where(column.isNotNull())
    return df


def range_borders(df: DataFrame, keys: Sequence[str], ranges: int | None = None) -> list[tuple]:
    """Up to ranges-1 ascending key tuples that split df into ranges of similar row count.

    A number comes from one approximate-percentile aggregate, a compound key from a sample of fixed
    expected size: what reaches the driver does not grow with df.
    """
    ranges = ranges or range_count(df)
    if ranges < 2:
        return []
    if len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, T.NumericType):
        steps = [i / ranges for i in range(1, ranges)]
        found = df.agg(F.percentile_approx(keys[0], steps, max(1000, 20 * ranges)).alias("b")).first()["b"]
        return [(b,) for b in sorted(set(found or []))]
    rows = df.count()
    if rows == 0:
        return []
    share = min(1.0, SAMPLE_PER_RANGE * ranges / rows)
    picked = df.select(*keys)
    if share < 1.0:
        picked = picked.sample(withReplacement=False, fraction=share, seed=17)
    sample = sorted(tuple(r) for r in picked.collect())
    if not sample:
        return []
    step = len(sample) / ranges
    borders: list[tuple] = []
    for i in range(1, ranges):
        border = sample[min(len(sample) - 1, int(i * step))]
        if not borders or border > borders[-1]:
            borders.append(border)
    return borders


def with_range(df: DataFrame, keys: Sequence[str], borders: Sequence[tuple]) -> DataFrame:
    """df plus `_range`, the index of the range between borders that a row's key falls into."""
    if not borders:
        return df.withColumn("_range", F.lit(0))
    if len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, T.NumericType):
        splits = sorted({float(b[0]) for b in borders} - {float("inf"), float("-inf")})
        if not splits:
            return df.withColumn("_range", F.lit(0))
        buckets = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_k", outputCol="_range")
        placed = buckets.transform(df.withColumn("_k", F.col(keys[0]).cast("double"))).drop("_k")
        return placed.withColumn("_range", F.col("_range").cast("int"))
    kinds = [df.schema[k].dataType for k in keys]

    def at_most(border: tuple) -> Column:
        verdict = None
        for key, kind, value in reversed(list(zip(keys, kinds, border))):
            literal = F.lit(value).cast(kind)
            if verdict is None:
                verdict = F.col(key) <= literal
            else:
                verdict = (F.col(key) < literal) | ((F.col(key) == literal) & verdict)
        return verdict

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(at_most(borders[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return df.withColumn("_range", search(0, len(borders)))


def prefix_sum(df: DataFrame, order: str, values: Mapping[str, Column], by: Sequence[str] = (),
               ranges: int | None = None) -> DataFrame:
    """One row per (by, order value) with sums, running sums and totals of each value.

    For a value `v` the result has `v` (sum over the tied rows), `cum_v` (running sum including
    the tied rows) and `tot_v` (sum over the by-group). Equal order values are merged by partial
    aggregation before anything is ordered, so a hot value costs one row per map task.
    """
    by = list(by)
    names = list(values)
    slim = _drop_missing(df.select(*by, order, *[c.alias(f"_v_{n}") for n, c in values.items()]), [order])
    borders = range_borders(slim, [order], ranges)
    merged = slim.groupBy(*by, order).agg(*[F.sum(f"_v_{n}").alias(n) for n in names])
    merged = with_range(merged, [order], borders)
    inside = Window.partitionBy(*by, "_range").orderBy(order)
    local = merged.select(
        *by, "_range", order, *names,
        *[F.sum(n).over(inside).alias(f"_in_{n}") for n in names])
    totals = merged.groupBy(*by, "_range").agg(*[F.sum(n).alias(n) for n in names])
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_range",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in names],
        *[F.sum(n).over(group).alias(f"tot_{n}") for n in names])
    if not by:
        offsets = F.broadcast(offsets)  # at most one row per range
    joined = local.join(offsets, [*by, "_range"])
    return joined.select(
        *by, order, *names,
        *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(f"cum_{n}") for n in names],
        *[F.col(f"tot_{n}") for n in names])


def ordered_index(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "idx",
                  total: str | None = None, ranges: int | None = None) -> DataFrame:
    """Number the rows 0, 1, 2, ... in ascending `order` (which must be unique) per by-group.

    NaN comes after all numbers and null last; a null group is a group. Rows are range-partitioned on (by, order)
    and sorted once, so one hot group, or one hot leading order value, is shared between many tasks; the plan
    does not grow with the number of ranges. `total` adds the row count of the group.
    """
    by, order = list(by), list(order)
    keys = [F.col(k).asc_nulls_last() for k in [*by, *order]]
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    fixed = cut_lineage(dealt.sortWithinPartitions(*keys)).withColumn("_at", F.monotonically_increasing_id())
    placed = fixed.withColumn("_range", F.shiftright("_at", PLACE_BITS)).withColumn(
        "_in", F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    counts = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_in").alias("_first"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_by{i}") for i, k in enumerate(by)], F.col("_range").alias("_of"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_off"),
        F.sum("_rows").over(group).alias("_total"))
    if not by:
        offsets = F.broadcast(offsets)  # at most one row per range
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_by{i}"))
    numbered = placed.join(offsets, same)
    extra = [F.col("_total").alias(total)] if total else []
    return numbered.select(*df.columns, (F.col("_in") + F.col("_off")).cast("long").alias(name), *extra)


def average_rank(df: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct value: count `n`, mean 1-based rank of its ties, and that rank over the row count."""
    base = prefix_sum(df, order, {"n": F.lit(1)}, by)
    rank = F.col("cum_n") - (F.col("n") - 1) / 2
    return base.select(*by, order, "n", rank.alias("avg_rank"), (rank / F.col("tot_n")).alias("rank_share"))


def percent_rank_ordinal(df: DataFrame, column: str, key: str, name: str) -> DataFrame:
    """0-based position in ascending order over the row count; equal values are ordered by key."""
    indexed = ordered_index(df, [column, key], name="_i", total="_n")
    return indexed.select(*df.columns, (F.col("_i") / F.col("_n")).alias(name))


def rank_bin(df: DataFrame, column: str, key: str, groups: int, name: str) -> DataFrame:
    """ceil(groups * position / rows): fills bins in order, unlike ntile's remainder rule."""
    indexed = ordered_index(df, [column, key], name="_i", total="_n")
    # whole-number ceiling: (g*r + n - 1) div n, free of floating point edges
    number = F.floor((F.lit(groups) * (F.col("_i") + 1) + F.col("_n") - 1) / F.col("_n"))
    return indexed.select(*df.columns, number.cast("int").alias(name))


def shift(df: DataFrame, value: str, order: Sequence[str], steps: int, name: str, fill=0,
          by: Sequence[str] = ()) -> DataFrame:
    """Value `steps` rows earlier in the order, `fill` where there is none.

    The numbered rows are cut into blocks; the last `steps` rows of a block are handed on to the next one, so that
    every earlier value is in the block of the row that asks for it.
    """
    indexed = ordered_index(df, order, by, name="_i")
    size = max(SHIFT_BLOCK, 4 * steps)
    block = F.floor(F.col("_i") / size)
    handed = F.pmod(F.col("_i"), F.lit(size)) >= size - steps
    copies = F.when(handed, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = indexed.withColumn("_ahead", F.explode(copies)).withColumn("_block", block + F.col("_ahead"))
    within = Window.partitionBy(*by, "_block").orderBy("_i")
    shifted = dealt.withColumn("_earlier", F.lag(value, steps).over(within)).where("_ahead = 0")
    result = F.when(F.col("_i") >= steps, F.col("_earlier")).otherwise(F.lit(fill))
    return shifted.select(*df.columns, result.cast(df.schema[value].dataType).alias(name))


def subseries(df: DataFrame, order: Sequence[str], parts: int, window: int) -> DataFrame:
    """Cut one ordered series into `parts` equal contiguous series and those into row windows.

    Adds idx, series_id, pos, win. Rows past parts * floor(n / parts) do not fit and are left out,
    as are incomplete last windows.
    """
    indexed = ordered_index(df, order, name="idx", total="_n")
    size = F.floor(F.col("_n") / parts)
    cut = (indexed.withColumn("_size", size).where(F.col("idx") < F.col("_size") * parts)
           .withColumn("series_id", F.floor(F.col("idx") / F.col("_size")).cast("int"))
           .withColumn("pos", F.pmod(F.col("idx"), F.col("_size")).cast("long"))
           .withColumn("win", F.floor(F.col("pos") / window).cast("long"))
           .where((F.col("win") + 1) * window <= F.col("_size")))
    return cut.drop("_n", "_size")


def every_nth(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Rows 0, n, 2n, ... of the order, with their position."""
    return ordered_index(df, order, name="idx").where(F.pmod(F.col("idx"), F.lit(n)) == 0)


def top_share(df: DataFrame, group: Sequence[str], weight: str, tie: str, n: int) -> DataFrame:
    """The n heaviest rows per group with their share of the weight of those n, two decimals.

    Spark keeps only n rows per group and map task before it shuffles (window group limit).
    """
    order = Window.partitionBy(*group).orderBy(F.col(weight).desc(), F.col(tie))
    top = df.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= n)
    return top.withColumn(
        "share", F.round(F.try_divide(F.col(weight), F.sum(weight).over(Window.partitionBy(*group))), 2))
