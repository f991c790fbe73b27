"""Exact top-k by inner product with M-trees and best-first search.

The greatest inner product is a least distance once every vector gets one more component that brings all to the same length M: then
|q - x|^2 = |q|^2 + M^2 - 2 <q, x> with 0 as the query's own extra component. Vectors are dealt to the nearest of a few pivots and,
from there, to trees of bounded size. A tree is made of pages of metric nodes: routing objects with covering radii, and every entry
with its distance to the parent. A query first searches the tree of its nearest pivot, then those trees that the
distance of its k-th find does not rule out. Within a tree, nodes wait in a queue by their least possible distance, and entries whose
stored parent distance already proves them too far are never computed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from analystry.session import scratch_path

SCALE = 1024
#: Pivots at most (taken from the rows with the least hash), rows of a tree, and entries of a page.
MOST_PIVOTS, TREE_ROWS, PAGE = 64, 8192, 64
#: Queries that search one copy of a tree.
QUERY_BLOCK = 1024


def finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - centre) ** 2).sum(axis=1), 0))


class Page:
    """A node: rows of its entries, their distances to the node's routing object, and, unless it is a leaf, radii and pages below."""

    __slots__ = ("entries", "to_parent", "radii", "below")

    def __init__(self, entries, to_parent, radii=None, below=None):
        self.entries, self.to_parent, self.radii, self.below = entries, to_parent, radii, below


class MTree:
    """A bulk-loaded M-tree over the rows of a matrix."""

    def __init__(self, points: np.ndarray, longest: float):
        self.points, self.longest = points, longest
        rows = np.arange(len(points))
        self.router = 0
        self.root = self._load(rows, self.router)

    def _load(self, rows: np.ndarray, router: int) -> Page:
        to_router = distances(self.points[rows], self.points[router])
        if len(rows) <= PAGE:
            return Page(rows, to_router)
        heads = rows[np.unique(np.linspace(0, len(rows) - 1, min(PAGE, -(-len(rows) // (PAGE // 2)))).astype(int))]
        centres = self.points[heads]
        squared = (self.points[rows] ** 2).sum(axis=1)[:, None] + (centres ** 2).sum(axis=1) - 2 * self.points[rows] @ centres.T
        owner = squared.argmin(axis=1)
        if len(np.unique(owner)) == 1:  # equal or nearly equal rows: any split is as good
            owner = np.arange(len(rows)) * len(heads) // len(rows)
        entries, radii, below = [], [], []
        for k, head in enumerate(heads):
            part = rows[owner == k]
            if len(part):
                entries.append(head)
                radii.append(distances(self.points[part], self.points[head]).max())
                below.append(self._load(part, head))
        entries = np.array(entries)
        return Page(entries, distances(self.points[entries], self.points[router]), np.array(radii), below)

    def search(self, query: np.ndarray, ids: np.ndarray, own: int, k: int, least: float) -> tuple[list[tuple[float, int]], int]:
        """The k rows of greatest inner product as (product, -id), best first, own id left out, and how many products were taken.

        Products below `least` are not looked for. Products are exact; the distances that rule entries out come from them and allow
        for rounding, so that all ties at the k-th place are met.
        """
        square = float((query ** 2).sum()) + self.longest

        def away(products: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(square - 2.0 * products, 0.0))

        def reach(product: float) -> float:
            return float(np.sqrt(max(square - 2.0 * product, 0.0))) * (1 + 1e-9) + 1e-6 if product > -np.inf else np.inf

        limit = reach(least)
        best: list[tuple[float, int]] = []  # heap of (product, -id): the worst find is on top
        taken = 1
        waiting = [(0.0, 0, self.root, float(away(self.points[self.router] @ query)))]
        ticket = 0
        while waiting:
            nearest, _, page, to_router = heapq.heappop(waiting)
            if nearest > limit:
                break
            aside = np.abs(to_router - page.to_parent)
            if page.below is None:
                rows = page.entries[aside <= limit]
                rows = rows[ids[rows] != own]
                taken += len(rows)
                for item in zip((self.points[rows] @ query).tolist(), (-ids[rows]).tolist()):
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k:
                    limit = min(limit, reach(best[0][0]))
            else:
                open_ = np.flatnonzero(aside - page.radii <= limit)
                taken += len(open_)
                routers = away(self.points[page.entries[open_]] @ query)
                for at, distance in zip(open_.tolist(), routers.tolist()):
                    bound = max(distance - float(page.radii[at]), 0.0)
                    if bound <= limit:
                        ticket += 1
                        heapq.heappush(waiting, (bound, ticket, page.below[at], distance))
        return sorted(best, reverse=True), taken


def _augmented(vectors: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([vectors, np.sqrt(np.maximum(longest - (vectors ** 2).sum(axis=1), 0))])


def _as_matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for k, v in enumerate(column.to_pylist()):
        out[k, :len(v)] = v
    return out


def _tree_search(longest: float, width: int, k: int):
    """Rows ordered by (tree, block, is_query): the tree's rows, then its queries, to the k best of each query."""

    def found(tree_rows, queries) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([r.column("vec_id").to_numpy() for r in tree_rows])
        vectors = np.concatenate([_as_matrix(r.column("vector"), width) for r in tree_rows])
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        tree = MTree(_augmented(vectors, longest), longest)
        out = []
        for batch in queries:
            asked = np.column_stack([_as_matrix(batch.column("vector"), width), np.zeros(batch.num_rows)])
            for query, own, limit in zip(asked, batch.column("vec_id").to_pylist(), batch.column("limit").to_pylist()):
                best, taken = tree.search(query, ids, own, k, -np.inf if limit is None else float(limit))
                out += [(own, -minus_id, int(product), taken) for product, minus_id in best]
        columns = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["query_id", "vec_id", "score", "products"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tree_rows, queries = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, block = batch.column("tree").to_numpy(), batch.column("block").to_numpy()
            asks = batch.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1]), True])
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if (tree[low], block[low]) != place:
                    if tree_rows and queries:
                        yield from found(tree_rows, queries)
                    place, tree_rows, queries = (tree[low], block[low]), [], []
                (queries if asks[low] else tree_rows).append(batch.slice(low, high - low))
        if tree_rows and queries:
            yield from found(tree_rows, queries)

    return search


def _searched(rows: DataFrame, visits: DataFrame, longest: float, width: int, k: int) -> DataFrame:
    """Every visit (tree, vec_id, vector, limit) answered; a tree is copied for each block of its queries."""
    blocks = visits.groupBy("tree").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    asked = visits.join(blocks, "tree").select("tree", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks")).alias("block"), F.lit(True).alias("is_query"), "vec_id", "vector", "limit")
    held = rows.join(blocks, "tree").select(
        "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("is_query"), "vec_id", "vector", F.lit(None).cast("long").alias("limit"))
    both = held.unionByName(asked).repartition("tree", "block").sortWithinPartitions("tree", "block", "is_query", "vec_id")
    return both.mapInArrow(_tree_search(longest, width, k), "query_id long, vec_id long, score long, products long")


def best_matches(embeddings: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """For each row that `queries` holds for, its k highest integer inner products: query_id, rank, vec_id, score.

    Components become floor(1024 * x) as integers; scores are exact while they stay below 2^53. Ties go to the smaller vec_id; a
    query's own vec_id is left out, also where it is repeated; other repeated rows are candidates each. Vectors that are null or hold
    null or non-finite components, and rows without vec_id, take no part; shorter vectors count as ended with zeros. With fewer than k
    others, all are returned; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asked"))
    path = scratch_path(spark, "topk-rows")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    count, longest, width = rows.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0.0)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    width = max(width, 1)
    wanted = int(min(MOST_PIVOTS, max(1, round(count / TREE_ROWS * 4))))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("vector").collect()
    pivots = np.zeros((len(sample), width))
    for n, r in enumerate(sample):
        pivots[n, :len(r[0])] = r[0]
    sent = spark.sparkContext.broadcast(_augmented(pivots, longest))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _augmented(_as_matrix(batch.column("vector"), width), longest)
            far = np.sqrt(np.maximum((points ** 2).sum(axis=1)[:, None] + (sent.value ** 2).sum(axis=1) - 2 * points @ sent.value.T, 0))
            near = far.argmin(axis=1) if len(points) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64()), pa.array(far[np.arange(len(near)), near], pa.float64())], [*batch.schema.names, "pivot", "far"])

    dealt_path = scratch_path(spark, "topk-dealt")
    rows.mapInArrow(deal, "vec_id long, vector array<double>, asked boolean, pivot long, far double").write.parquet(dealt_path)
    dealt = spark.read.parquet(dealt_path)
    # at most MOST_PIVOTS rows: a pivot's trees share its ball
    balls = {r["pivot"]: (r["far"], r["trees"]) for r in dealt.groupBy("pivot").agg(F.max("far").alias("far"), F.ceil(F.count("*") / TREE_ROWS).alias("trees")).collect()}
    trees_of = F.create_map(*[F.lit(int(x)) for p, (_, t) in balls.items() for x in (p, t)]) if balls else F.lit(None).cast("map<int,int>")
    tree = F.col("pivot") * F.lit(1 << 40) + F.pmod(F.xxhash64("vec_id"), F.element_at(trees_of, F.col("pivot").cast("int")))
    placed = dealt.withColumn("tree", tree)
    asked = placed.where("asked").dropDuplicates(["vec_id"])
    first_path = scratch_path(spark, "topk-first")
    first_visits = asked.select("tree", "vec_id", "vector", F.lit(None).cast("long").alias("limit"))
    _searched(placed, first_visits, longest, width, k).write.parquet(first_path)
    first = spark.read.parquet(first_path)
    limits = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(
        F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("least")).alias("limit"))
    order = sorted(balls)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.column_stack([_as_matrix(batch.column("vector"), width), np.zeros(batch.num_rows)])
            far = np.sqrt(np.maximum((points ** 2).sum(axis=1)[:, None] + (sent.value ** 2).sum(axis=1) - 2 * points @ sent.value.T, 0))
            limit = batch.column("limit").to_pylist()
            squares = (points ** 2).sum(axis=1)
            reach = np.array([np.inf if s is None else np.sqrt(max(q + longest - 2.0 * s, 0.0)) for s, q in zip(limit, squares)])
            visits = []
            for row, home in enumerate(batch.column("tree").to_pylist()):
                chosen = [p for p in order if far[row, p] - balls[p][0] <= reach[row] * (1 + 1e-9) + 1e-6]
                visits.append([t for p in chosen for t in range(p << 40, (p << 40) + balls[p][1]) if t != home])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), batch.column("limit"), pa.array(visits, pa.list_(pa.int64()))], ["vec_id", "vector", "limit", "visits"])

    routed = asked.select("vec_id", "vector", "tree").join(limits, "vec_id", "left").mapInArrow(route, "vec_id long, vector array<double>, limit long, visits array<long>")
    later = _searched(placed, routed.select(F.explode("visits").alias("tree"), "vec_id", "vector", "limit"), longest, width, k)
    ranked = first.unionByName(later).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
