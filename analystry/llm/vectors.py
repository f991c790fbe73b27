"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into halves, each with its own codebook; the pairs of codewords are the cells of a grid. A vector visits cells by
multi-sequence traversal, the pairs of both halves in the order of their distance bounds. The bound of a codeword is the distance
to the plane between it and the vector's own codeword, which no vector of the other cell is nearer than; the traversal stops where
two bounds together exceed the radius of the wanted cosine. So the target recall is 1, and what is visited is verified by its cosine.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from analystry.llm.components import connected_components, local_components
from analystry.session import scratch_path

LEAST_COSINE = 0.93
#: Rows the codebooks are fitted on at most, those with the least hash; every row is indexed.
SAMPLE_ROWS = 1 << 13
#: Vectors of a cell of the largest label, on average, and codewords of a half at least and at most. A vector is copied to every cell
#: that it visits, so cells are as large as a task takes in at once.
CELL_ROWS, LEAST_CODES, MOST_CODES = 1024, 2, 256
#: Vectors of a cell that meet in one task; larger cells are worked off in blocks.
BLOCK = 4096
#: What rounding may add to a bound.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector is there, has no null or non-finite component and is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by the greatest component first, so that squares stay in range."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def fit_codebook(points: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """k-means centres of a bounded sample, started from rows spread over it."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    centres = points[np.linspace(0, len(points) - 1, min(codes, len(points))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return np.unique(centres, axis=0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((points ** 2).sum(axis=1)[:, None] + (centres ** 2).sum(axis=1) - 2 * points @ centres.T, 0)


class MultiIndex:
    """Two codebooks over halves of unit vectors."""

    def __init__(self, sample: np.ndarray, codes: int):
        self.half = sample.shape[1] // 2
        self.books = [fit_codebook(sample[:, :self.half], codes), fit_codebook(sample[:, self.half:], codes)]
        self.gaps = [np.sqrt(nearest(b, b)) for b in self.books]

    def cells_of(self, unit: np.ndarray, radius2: float) -> tuple[np.ndarray, list[list[int]]]:
        """Each vector's own cell, and the cells it visits: its own and later ones within the bound."""
        bounds, own = [], []
        for book, gap, part in zip(self.books, self.gaps, (unit[:, :self.half], unit[:, self.half:])):
            far = nearest(part, book)
            home = far.argmin(axis=1)
            beyond = far - far[np.arange(len(far)), home][:, None]
            bounds.append(np.square(np.maximum(beyond, 0) / np.maximum(2 * gap[home], 1e-12)))
            bounds[-1][np.arange(len(far)), home] = 0
            own.append(home)
        across = len(self.books[1])
        home = own[0] * across + own[1]
        order = [np.argsort(b, axis=1, kind="stable") for b in bounds]
        sorted_bounds = [np.take_along_axis(b, o, axis=1) for b, o in zip(bounds, order)]
        within = [(s <= radius2 + SLACK).sum(axis=1) for s in sorted_bounds]
        visits = []
        for k in range(len(unit)):
            first, second = sorted_bounds[0][k, :within[0][k]].tolist(), sorted_bounds[1][k, :within[1][k]].tolist()
            cells = [int(order[0][k, i]) * across + int(order[1][k, j]) for i, j in traversal(first, second, radius2 + SLACK)]
            visits.append([c for c in cells if c >= home[k]])
        return home, visits


def traversal(first: list[float], second: list[float], most: float) -> Iterator[tuple[int, int]]:
    """Places (i, j) of two rising sequences in the order of first[i] + second[j], up to `most`."""
    queue = [(first[0] + second[0], 0, 0)] if first and second else []
    while queue and queue[0][0] <= most:
        _, i, j = heapq.heappop(queue)
        yield i, j
        if j + 1 < len(second):
            heapq.heappush(queue, (first[i] + second[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(queue, (first[i + 1] + second[0], i + 1, 0))


def _links(least: float, kind: str):
    """Rows ordered by (site, block, visitor), members of a block before its visitors, to counts and spanning links.

    Gives (a, b, edge): b links of a, or a link between a and b. Visitors come in Arrow batches and are never held together; a
    batch's links become a forest, so that no more rows are returned than were read.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, members, counts = None, None, None

        def flush():
            found = np.flatnonzero(counts) if counts is not None else []
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(members[0][found]), pa.array(counts[found]), pa.array(np.zeros(len(found), bool))], ["a", "b", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            site, block = (batch.column(c).to_numpy() for c in ("site", "block"))
            visitor = batch.column("visitor").to_numpy(zero_copy_only=False)
            ids, own, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "own", "weight"))
            vectors = units(np.frombuffer(b"".join(batch.column("raw").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64))
            cuts = np.flatnonzero(np.r_[True, (site[1:] != site[:-1]) | (block[1:] != block[:-1]) | (visitor[1:] != visitor[:-1]), True])
            for low, high in zip(cuts[:-1], cuts[1:]):
                part = slice(low, high)
                if (site[low], block[low]) != place:
                    yield from flush()
                    place, members, counts = (site[low], block[low]), None, None
                if not visitor[low]:
                    held = (ids[part], weight[part], vectors[part])
                    members = held if members is None else tuple(np.concatenate(x) for x in zip(members, held))
                    counts = np.zeros(len(members[0]), np.int64)
                    continue
                if members is None:
                    continue
                for first in range(low, high, 512):
                    rows = slice(first, min(first + 512, high))
                    hit = vectors[rows] @ members[2].T >= least
                    hit &= ~own[rows][:, None] | (members[0] < ids[rows][:, None])
                    i, j = np.nonzero(hit)
                    if not len(i):
                        continue
                    counts += weight[rows] @ hit
                    seen = hit @ members[1]
                    some = np.flatnonzero(seen)
                    nodes, at = np.unique(np.concatenate([ids[rows][i], members[0][j]]), return_inverse=True)
                    label = local_components(at[:len(i)], at[len(i):], len(nodes))
                    joined = np.flatnonzero(label != np.arange(len(nodes)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate([ids[rows][some], nodes[joined]])), pa.array(np.concatenate([seen[some], nodes[label[joined]]])),
                        pa.array(np.r_[np.zeros(len(some), bool), np.ones(len(joined), bool)])], ["a", "b", "edge"])
        yield from flush()

    return links


def near_vectors(embeddings: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """One row per row of `embeddings` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of equal label, not null, are linked from a cosine of `least` in double precision. Equal vectors of a label are one class,
    searched once and counted each. Vectors that are null, zero, or hold null or non-finite components, and rows without
    label, are linked with nothing; vectors of different length are not compared. Rows without vec_id are linked with nothing
    and not kept. Rows that repeat a vec_id count each. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("label"))
    fit = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    path = scratch_path(spark, "vector-classes")
    rows.where(fit).groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")).write.parquet(path)
    classes = spark.read.parquet(path)
    per_label = classes.groupBy("label", F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    count, width = per_label.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("size"), F.lit(2))).first()
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vector").collect()
    width = max(2, width)
    codes = int(min(MOST_CODES, max(LEAST_CODES, round((count / CELL_ROWS) ** 0.5))))
    index = spark.sparkContext.broadcast(MultiIndex(units(padded([r[0] for r in sample], width)) if sample else np.zeros((0, width)), codes))
    radius2 = 2 - 2 * least
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"  # components travel as they are stored

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            rows = padded(vectors, width)
            unit = units(rows) if vectors else rows
            home, visits = index.value.cells_of(unit, radius2)
            yield pa.RecordBatch.from_arrays([
                batch.column("group"), batch.column("id"), batch.column("weight"), pa.array(home.astype(np.int64)),
                pa.array(visits, pa.list_(pa.int64())), pa.array([r.tobytes() for r in rows.astype(kind)], pa.binary())],
                ["group", "id", "weight", "cell", "visits", "raw"])

    group = F.concat_ws(":", F.size("vector"), F.col("label").cast("string"))
    placed_path = scratch_path(spark, "vector-cells")
    classes.select(group.alias("group"), "id", "weight", "vector").mapInArrow(
        place, "group string, id long, weight long, cell long, visits array<long>, raw binary").write.parquet(placed_path)
    placed = spark.read.parquet(placed_path)
    cells = placed.groupBy("group", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    site = F.struct("group", "cell")
    members = placed.join(cells, ["group", "cell"]).select(
        site.alias("at"), F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.lit(False).alias("visitor"), "id", F.lit(False).alias("own"), "weight", "raw")
    visiting = placed.select("group", F.col("cell").alias("home"), F.explode("visits").alias("cell"), "id", "weight", "raw").join(cells, ["group", "cell"])
    visitors = visiting.select(
        site.alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visitor"), "id",
        (F.col("home") == F.col("cell")).alias("own"), "weight", "raw")
    both = members.unionByName(visitors).withColumn("site", F.xxhash64("at")).repartition("at", "block").sortWithinPartitions("at", "block", "visitor", "id")
    found_path = scratch_path(spark, "vector-links")
    both.select("site", "block", "visitor", "id", "own", "weight", "raw").mapInArrow(_links(least, kind), "a long, b long, edge boolean").write.parquet(found_path)
    found = spark.read.parquet(found_path)
    counts = found.where("NOT edge").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    components = connected_components(found.where("edge")).withColumnRenamed("node", "id")
    result_path = scratch_path(spark, "vector-result")
    classes.join(counts, "id", "left").join(components, "id", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")).write.parquet(result_path)
    named = spark.read.parquet(result_path)
    linked = rows.where(fit).join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
