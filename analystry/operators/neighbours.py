"""Exact nearest neighbours by Euclidean distance, without comparing everything with everything where that can be avoided.

The base is split into cells around a fixed number of pivots. From the distances to the pivots and
the few smallest distances inside each cell comes an upper bound for every query's k-th distance;
by the triangle inequality only cells that reach into that bound can hold a neighbour (Lu, Shen,
Chen, Ooi: k nearest neighbour joins, VLDB 2012). Queries of neighbouring cells make up a block,
and a block streams the cells that it needs, the nearest first, through one task: what is held are
the block, the k best of each of its queries and one batch of base rows. The bound tightens on the
way, so that later cells are left out per query. The number of blocks does not grow with the
queries before they hold MOST_QUERIES each, so what is shuffled grows as the base does.
Identical base vectors are merged first and keep only the ids that can appear in an answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from analystry.functions.numeric import euclidean
from analystry.session import cut_lineage

PIVOTS = 128
ROWS_PER_PIVOT = 512
#: Base rows compared at once.
BLOCK = 4096
#: Queries of a block, at least and at most.
LEAST_QUERIES, MOST_QUERIES = 512, 1 << 16
#: Distances held at once, and pairs whose exact distance is formed at once.
CELLS_AT_ONCE, PAIRS_AT_ONCE = 1 << 19, 1 << 16
SLACK = 1e-9


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact pairwise distances of two small blocks."""
    out = np.empty((len(a), len(b)))
    for j in range(len(b)):
        gap = a - b[j]
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _distinct_base(base: DataFrame, key: str, vector: str, keep: int) -> DataFrame:
    """(v, ids): one row per distinct vector with its `keep` smallest ids."""
    rows = base.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    # row limit per group is applied in every map task before the shuffle
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    first = rows.withColumn("_nth", nth).where(F.col("_nth") <= keep)
    return first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


class _Search:
    """The queries of one block, with the k best (distance, id) of each so far."""

    def __init__(self, keys: pa.Array, vectors: np.ndarray, pivots: np.ndarray, k: int, skip_same_key: bool):
        self.keys, self.vectors, self.k = keys, vectors, k
        self.away = _distances(vectors, pivots)
        self.squares = np.einsum("ij,ij->i", vectors, vectors)
        self.own = keys.to_numpy(zero_copy_only=False) if skip_same_key else None
        self.dist = np.full((len(vectors), k), np.inf)
        self.ids = np.full((len(vectors), k), np.iinfo("int64").max)
        # no k-th distance is above this; what was found since the last merge waits
        self.worst, self.waiting, self.held = np.full(len(vectors), np.inf), [], 0

    def add(self, cell: int, radius: float, base: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> None:
        """Rows of one cell; row j has the ids offsets[j]:offsets[j + 1]."""
        near = np.nonzero(self.away[:, cell] - radius <= self.worst * (1 + SLACK) + SLACK)[0]
        squares = np.einsum("ij,ij->i", base, base)
        tops = [x for x in (squares.max(initial=0.0), self.squares.max(initial=0.0)) if np.isfinite(x)]
        kind = np.float32 if 1e-20 < max(tops, default=0.0) < 1e30 else np.float64
        # rounding takes or adds at most this share of both squares
        share, least = 2 * (base.shape[1] + 8) * float(np.finfo(kind).eps), 1e-38 if kind is np.float32 else 0.0
        right = np.vstack([-2 * base.T, (1 - share) * squares]).astype(kind)
        more, alone = (2 * share * squares).astype(kind), None
        if self.own is not None:
            first = ids[offsets[:-1]]
            alone = np.where(np.maximum.reduceat(ids, offsets[:-1]) == np.minimum.reduceat(ids, offsets[:-1]), first, -1)
        step = max(1, CELLS_AT_ONCE // len(base))
        for start in range(0, len(near), step):
            part = near[start:start + step]
            left = np.hstack([self.vectors[part], np.ones((len(part), 1))]).astype(kind)
            score, square = left @ right, self.squares[part]
            open_ = np.nonzero(np.isinf(self.worst[part]))[0]
            if len(open_) and len(base) > self.k:
                at_most = score[open_] + more
                if alone is not None:
                    at_most[alone == self.own[part[open_]][:, None]] = np.inf
                top = np.partition(at_most, self.k - 1, axis=1)[:, self.k - 1] + (1 + share) * square[open_] + least
                self.worst[part[open_]] = np.sqrt(np.maximum(top, 0))
            limit = self.worst[part] ** 2 * (1 + SLACK) - (1 - share) * square + least
            row, place = np.nonzero(score <= np.nextafter(limit.astype(kind), kind(np.inf))[:, None])
            for at in range(0, len(row), PAIRS_AT_ONCE):
                self._keep(part[row[at:at + PAIRS_AT_ONCE]], place[at:at + PAIRS_AT_ONCE], base, offsets, ids)

    def _keep(self, row: np.ndarray, place: np.ndarray, base: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> None:
        gap = self.vectors[row] - base[place]
        dist, many = np.sqrt(np.einsum("ij,ij->i", gap, gap)), offsets[place + 1] - offsets[place]
        within = np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)
        row, dist, found = np.repeat(row, many), np.repeat(dist, many), ids[np.repeat(offsets[place], many) + within]
        better = dist <= self.worst[row] * (1 + SLACK)
        if self.own is not None:
            better &= found != self.own[row]
        self.waiting.append((row[better], dist[better], found[better]))
        self.held += int(better.sum())
        if self.held >= max(PAIRS_AT_ONCE, self.dist.size // 2):
            self._merge()

    def _merge(self) -> None:
        if not self.held:
            return
        row, dist, found = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.held = [], 0
        who, slot = np.unique(row, return_inverse=True)
        slot = np.concatenate([slot, np.repeat(np.arange(len(who)), self.k)])
        dist = np.concatenate([dist, self.dist[who].ravel()])
        found = np.concatenate([found, self.ids[who].ravel()])
        order = np.lexsort((found, dist, slot))
        slot = slot[order]
        best = order[np.arange(len(slot)) - np.searchsorted(slot, slot) < self.k]
        self.dist[who], self.ids[who] = dist[best].reshape(-1, self.k), found[best].reshape(-1, self.k)
        self.worst[who] = np.minimum(self.worst[who], self.dist[who, -1])

    def answers(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for start in range(0, len(self.dist), 4096):
            row, nth = np.nonzero(np.isfinite(self.dist[start:start + 4096]))
            row += start
            yield pa.RecordBatch.from_arrays([self.keys.take(pa.array(row)), pa.array(self.ids[row, nth]), pa.array(self.dist[row, nth])],
                                             ["query_id", "base_id", "dist"])


def _blocks_of(loads: np.ndarray, pivots: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Per cell its first block and its number of blocks, and the number of all: near cells share a block, a large cell has several."""
    per, first, many = -(-int(loads.sum()) // wanted), np.zeros(len(loads), "int64"), np.ones(len(loads), "int64")
    left, at, used, held = set(range(len(loads))), 0, 0, 0
    while left:
        left.discard(at)
        if held and held + loads[at] > per:
            used, held = used + 1, 0
        first[at], many[at] = used, max(1, -(-int(loads[at]) // per))
        used, held = used + int(many[at]) - 1, held + int(loads[at]) if many[at] == 1 else per
        rest = np.array(sorted(left), dtype="int64")
        at = int(rest[((pivots[rest] - pivots[at]) ** 2).sum(axis=1).argmin()]) if left else 0
    return first, many, used + 1


def knn_join(queries: DataFrame, base: DataFrame, k: int, query_key: str, base_key: str, vector: str,
             exclude_same_key: bool = False) -> DataFrame:
    """(query_id, base_id, dist, rnk): the k nearest base rows of every query row.

    Ties go to the smaller base key. Keys are whole numbers; `exclude_same_key` leaves a row out of
    its own neighbours when a table is joined with itself. Base rows without a key are nobody's neighbours.
    """
    want = k + 1 if exclude_same_key else k
    spark = base.sparkSession
    # merged once and read several times below
    distinct = cut_lineage(_distinct_base(base, base_key, vector, want).where(F.size("ids") > 0))
    size = distinct.count()
    nothing = spark.createDataFrame([], "query_id long, base_id long, dist double, rnk int")
    if size == 0:
        return nothing
    wanted_pivots = max(1, min(PIVOTS, size // ROWS_PER_PIVOT))
    share = min(1.0, 4.0 * wanted_pivots / size)
    sample = distinct.select("v") if share == 1.0 else distinct.select("v").sample(fraction=share, seed=11)
    pivots = np.array([r["v"] for r in sample.limit(wanted_pivots).collect()] or [distinct.select("v").first()["v"]])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = _distances(_matrix(batch["v"]), pivots)
            cell = d.argmin(axis=1)
            yield batch.assign(cell=cell.astype("int32"), away=d[np.arange(len(d)), cell])

    placed = cut_lineage(distinct.mapInPandas(assign, "v array<double>, ids array<long>, cell int, away double"))
    # per cell: radius, and its `want` smallest distances with their id counts
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("away"))
    near = (placed.select("cell", "away", F.size("ids").alias("m")).withColumn("_nth", nth)
            .where(F.col("_nth") <= want).select("cell", "away", "m").collect())
    radius = np.full(len(pivots), -np.inf)
    for c in placed.groupBy("cell").agg(F.max("away").alias("radius")).collect():
        radius[c["cell"]] = c["radius"]
    # one entry per id, `want` of each cell
    per_cell: dict[int, list[float]] = {}
    for r in sorted(near, key=lambda r: (r["cell"], r["away"])):
        per_cell.setdefault(r["cell"], []).extend([r["away"]] * r["m"])
    near_cell = np.array([cell for cell, entries in per_cell.items() for _ in entries[:want]])
    near_away = np.array([away for entries in per_cell.values() for away in entries[:want]])

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(cell of a query, cell that it needs, queries) of each batch."""
        for batch in batches:
            d = _distances(_matrix(batch["v"]), pivots)
            bound = np.full(len(d), np.inf)
            if len(near_away) >= want:
                step = max(1, CELLS_AT_ONCE // len(near_away))
                for start in range(0, len(d), step):
                    at_most = d[start:start + step, near_cell] + near_away
                    bound[start:start + step] = np.partition(at_most, want - 1, axis=1)[:, want - 1]
            hit = (d - radius <= bound[:, None] * (1 + SLACK) + SLACK) & np.isfinite(radius)
            own = d.argmin(axis=1)
            row, cell = np.nonzero(hit)
            pairs = pd.DataFrame({"own": own[row], "cell": cell}).value_counts().reset_index(name="n")
            # every query is counted once, below its own cell and no needed one
            yield pd.concat([pairs, pd.DataFrame({"own": own, "cell": -1}).value_counts().reset_index(name="n")]).astype("int64")

    asked = queries.select(F.col(query_key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    pairs = asked.select("v").mapInPandas(visits, "own long, cell long, n long").groupBy("own", "cell").agg(F.sum("n").alias("n")).collect()
    loads = np.zeros(len(pivots), "int64")
    for r in pairs:
        if r["cell"] < 0:
            loads[r["own"]] = r["n"]
    if not loads.sum():
        return nothing
    total = int(loads.sum())
    wanted = max(2 * spark.sparkContext.defaultParallelism, -(-total // MOST_QUERIES))
    first, many, blocks = _blocks_of(loads, pivots, max(1, min(wanted, total // LEAST_QUERIES)))
    between = _distances(pivots, pivots)
    nearest: dict[tuple[int, int], float] = {}
    for r in pairs:
        if r["cell"] >= 0:
            for block in range(first[r["own"]], first[r["own"]] + many[r["own"]]):
                way = (int(block), r["cell"])
                nearest[way] = min(nearest.get(way, np.inf), float(between[r["own"], r["cell"]]))
    ways = spark.createDataFrame([(b, c, d) for (b, c), d in nearest.items()] or [(0, -1, 0.0)], "block int, cell int, step double")

    def pick(numbers: np.ndarray):
        return F.element_at(F.lit(numbers), F.col("cell") + 1)

    here = asked.withColumn("ids", F.array("query_id")).mapInPandas(
        lambda batches: (b.drop(columns="away") for b in assign(batches)), "query_id long, v array<double>, ids array<long>, cell int")
    block = (pick(first) + F.pmod(F.xxhash64("query_id"), pick(many))).cast("int")
    left = here.select(block.alias("block"), F.lit(-1.0).alias("step"), F.lit(-1).alias("cell"), "v", "ids")
    right = placed.join(F.broadcast(ways), "cell").select("block", "step", "cell", "v", "ids")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, found = None, [], None
        for batch in batches:
            at, cell = (batch.column(name).to_numpy() for name in ("block", "cell"))
            cuts = np.nonzero((at[1:] != at[:-1]) | (cell[1:] != cell[:-1]))[0] + 1
            cuts = np.union1d(cuts, np.arange(BLOCK, len(at), BLOCK))
            for start, end in zip([0, *cuts], [*cuts, len(at)], strict=True):
                if at[start] != block:
                    if found is not None:
                        yield from found.answers()
                    block, waiting, found = at[start], [], None
                rows = batch.slice(start, end - start)
                v = rows.column("v")
                vectors = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
                ids = rows.column("ids")
                if cell[start] < 0:
                    waiting.append((ids.flatten(), vectors))
                    continue
                if found is None:
                    if not waiting:
                        continue
                    keys = pa.concat_arrays([x for x, _ in waiting])
                    found = _Search(keys, np.concatenate([x for _, x in waiting]), pivots, k, exclude_same_key)
                offsets = ids.offsets.to_numpy()
                found.add(cell[start], radius[cell[start]], vectors, offsets - offsets[0], ids.flatten().to_numpy())
        if found is not None:
            yield from found.answers()

    together = left.unionByName(right).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "step", "cell")
    candidates = together.mapInArrow(search, "query_id long, base_id long, dist double")
    if exclude_same_key:
        candidates = candidates.where(F.col("query_id") != F.col("base_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "base_id"))
    return candidates.withColumn("rnk", rank).where(F.col("rnk") <= k).select("query_id", "base_id", "dist", "rnk")


def mean_neighbour_distance(df: DataFrame, key: str, vector: str, k: int = 49) -> DataFrame:
    """(query_id, loc): mean distance to the k nearest other rows."""
    return knn_join(df, df, k, key, key, vector, exclude_same_key=True).groupBy("query_id").agg(F.avg("dist").alias("loc"))


def nearest_value(grid: DataFrame, points: DataFrame, grid_key: str, point_key: str, vector: str, value: str) -> DataFrame:
    """(grid key, value of the nearest point)."""
    near = knn_join(grid, points, 1, grid_key, point_key, vector)
    values = points.select(F.col(point_key).cast("long").alias("base_id"), value)
    return near.join(values, "base_id").select(F.col("query_id").alias(grid_key), value, "dist")


def knn_classify(test: DataFrame, train: DataFrame, k: int, key: str, vector: str, label: str) -> DataFrame:
    """(key, predicted): majority vote of the k nearest training rows, ties to the smallest label."""
    near = knn_join(test, train, k, key, key, vector)
    labels = train.select(F.col(key).cast("long").alias("base_id"), F.col(label).alias("_label"))
    votes = near.join(labels, "base_id").groupBy("query_id", "_label").agg(F.count(F.lit(1)).alias("_n"))
    best = votes.groupBy("query_id").agg(F.min_by("_label", F.struct(-F.col("_n"), F.col("_label"))).alias("predicted"))
    return best.withColumnRenamed("query_id", key)


def _at_least_two(columns: list) -> list:
    return columns if len(columns) > 1 else columns * 2


def nearest_centroid(test: DataFrame, train: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, predicted, dist): class with the nearest mean vector.

    The fitted model, classes x dimensions numbers, is held in the plan; each test row is scored in place.
    """
    spots = train.select(F.col(label).alias("_l"), F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    means = spots.groupBy("_l", "pos").agg(F.avg("x").alias("m"))
    per_class = means.groupBy("_l").agg(F.array_sort(F.collect_list(F.struct("pos", "m")))["m"].alias("c"))
    kind = train.schema[label].dataType
    model = [(F.lit(r["_l"]).cast(kind), F.lit(np.array(r["c"]))) for r in per_class.collect()]
    rows = test.select(key, F.col(vector).cast("array<double>").alias("v"))

    best = F.least(*_at_least_two([
        F.struct(euclidean(F.col("v"), centre).alias("dist"), name.alias("predicted")) for name, centre in model]))
    return rows.select(key, best.alias("best")).select(key, "best.predicted", "best.dist")
