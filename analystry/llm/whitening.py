"""Whitening on leading principal components by Chebyshev-filtered subspace iteration.

Distinct integer vectors are packed into blocks once. A pass multiplies the covariance with a thin matrix without forming it: tasks
centre their rows, form X^T(XQ), and Spark adds up the shares. A few Lanczos steps bound the spectrum from below; a scaled Chebyshev
recurrence then damps what lies between that bound and the smallest Ritz value of the subspace, and QR and Rayleigh-Ritz follow, until
the residuals certify the components. The driver holds thin matrices only: dimensions x columns of the subspace, however many rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from analystry.session import scratch_path, spread

SCALE = 256
COMPONENTS = 4
#: Entries of a packed block, and of the rows that a task holds as doubles.
BLOCK_ENTRIES = 1 << 18
#: Columns of the subspace at first; twice as many whenever the residuals stop falling.
COLUMNS = 20
LANCZOS_STEPS = 12
DEGREE = 10
#: Residuals in terms of the largest eigenvalue: certified below the first, or below the second once they have stopped falling.
CERTAIN, NEARLY = 2e-14, 1e-9
#: Eigenvalues below this share of the trace are taken for zero, and their components left out.
ZERO = 1e-12
#: Columns whose sums travel in one row.
STRIPE = 32

_PACKED = "dimension int, n long, width int, data binary"


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) of every entry as double; null for vectors that are null, empty or hold null or non-finite entries."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when((F.size(vector) > 0) & sound, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of whole numbers) for each length of vector in a batch, in parts of bounded size."""
    sizes = column.value_lengths().to_numpy()
    flat, starts = column.flatten().to_numpy(), np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        rows, step = np.flatnonzero(sizes == d), max(1, BLOCK_ENTRIES // d)
        for k in range(0, len(rows), step):
            part = rows[k:k + step]
            yield part, flat[starts[part][:, None] + np.arange(d)]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in _rows(batch.column(0)):
            most = int(max(x.max(), -(x.min() + 1)))
            width = next(w for w in (2, 4, 8) if most < 1 << (8 * w - 1))
            yield pa.RecordBatch.from_pylist([{"dimension": x.shape[1], "n": len(rows), "width": width, "data": x.astype(f"<i{width}").tobytes()}], pa.schema(
                [("dimension", pa.int32()), ("n", pa.int64()), ("width", pa.int32()), ("data", pa.binary())]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for d, width, data in zip(batch["dimension"].to_pylist(), batch["width"].to_pylist(), batch["data"]):
            yield np.frombuffer(data.as_buffer(), dtype=f"<i{width}").reshape(-1, d)


def _sum_of_rows(blocks: DataFrame, dimension: int) -> list[int]:
    """Exact sums per dimension."""

    def share(batches):
        total = [0] * dimension
        for x in _blocks(batches):
            sums = x.astype(object).sum(axis=0) if x.itemsize == 8 else x.sum(axis=0, dtype=np.int64)
            total = [a + int(b) for a, b in zip(total, sums)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dimension), pa.int32()), pa.array(map(str, total), pa.string())], ["i", "v"])

    sums = blocks.mapInArrow(share, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return [int(r["v"]) for r in sorted(sums, key=lambda r: r["i"])]


class Covariance:
    """The covariance of packed distinct vectors as an operator on thin matrices: one distributed pass each."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        self.blocks, self.n, self.passes, self.trace = blocks, n, 0, None
        self.mean = np.array([s / n for s in sums])

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q, each row centred before it is multiplied. Also finds the trace."""
        (d, k), mean, self.passes = q.shape, self.mean, self.passes + 1
        sent = self.blocks.sparkSession.sparkContext.broadcast(q)

        def share(batches):
            basis, total, squares = sent.value, np.zeros((d, k)), 0.0
            for x in _blocks(batches):
                z = x - mean
                total += z.T @ (z @ basis)
                squares += float(np.vdot(z, z))
            padded = np.zeros((d + 1, -(-k // STRIPE) * STRIPE))
            padded[:d, :k], padded[d, 0] = total, squares
            for stripe in range(0, padded.shape[1], STRIPE):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(d + 1), pa.int32()), pa.array([stripe] * (d + 1), pa.int32()), *[pa.array(c) for c in padded[:, stripe:stripe + STRIPE].T]],
                    ["i", "stripe", *names])

        names = [f"v{c}" for c in range(STRIPE)]
        parts = self.blocks.mapInArrow(share, "i int, stripe int, " + ", ".join(f"{c} double" for c in names))
        out = np.zeros((d + 1, -(-k // STRIPE) * STRIPE))
        for r in parts.groupBy("i", "stripe").agg(*[F.sum(c) for c in names]).collect():  # dimensions x columns numbers
            out[r[0], r[1]:r[1] + STRIPE] = r[2:]
        sent.destroy()
        self.trace = out[d, 0] / self.n
        return out[:d, :k] / self.n


def lower_bound(v: Covariance, start: np.ndarray, steps: int = LANCZOS_STEPS) -> float:
    """A bound near the smallest eigenvalue: the smallest Ritz value of a few Lanczos steps less the last residual; 0 at least."""
    q, diagonal, beside = [start / np.linalg.norm(start)], [], []
    for _ in range(min(steps, len(start))):
        image = v.times(q[-1][:, None])[:, 0]
        diagonal.append(float(q[-1] @ image))
        for _ in range(2):
            image = image - np.array(q).T @ (np.array(q) @ image)
        rest = float(np.linalg.norm(image))
        beside.append(rest)
        if rest <= 1e-12 * max(abs(diagonal[0]), 1e-300):
            break
        q.append(image / rest)
    k = len(diagonal)
    ritz = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(beside[:k - 1], 1) + np.diag(beside[:k - 1], -1))
    return max(0.0, float(ritz[0]) - beside[-1])


def chebyshev(v: Covariance, q: np.ndarray, image: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of V times q: small on [low, high], growing up to `top`. image is V q."""
    half, middle = (high - low) / 2, (high + low) / 2
    first = sigma = half / (top - middle)
    before, now = q, (image - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (v.times(now) - middle * now) * (2 * following / half) - sigma * following * before
        sigma = following
    return now


def leading(v: Covariance, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, largest residual in terms of the largest eigenvalue)."""
    d = len(v.mean)
    draw, columns = np.random.default_rng(seed), min(d, max(COLUMNS, 2 * wanted))
    q = np.linalg.qr(draw.normal(size=(d, columns)))[0]
    low, last = None, np.inf
    while True:
        image = v.times(q)
        values, turn = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
        turn = turn[:, ::-1]
        values, q, image = values[::-1], q @ turn, image @ turn
        top, kept = float(values[0]), min(wanted, columns)
        if v.trace <= 0 or top <= 0:
            return np.zeros(0), q[:, :0], 0.0
        residual = float(np.linalg.norm(image[:, :kept] - q[:, :kept] * values[:kept], axis=0).max()) / top
        stalled = residual > last / 2
        if residual <= CERTAIN or stalled and residual <= NEARLY or columns == d:
            return values[:kept], q[:, :kept], residual
        if stalled:
            more = min(d, 2 * columns)
            q, columns, last = np.linalg.qr(np.column_stack([q, draw.normal(size=(d, more - columns))]))[0], more, np.inf
            continue
        last = residual
        if low is None:
            low = lower_bound(v, draw.normal(size=d))
        high = max(float(values[-1]), low + 1e-3 * top)
        q = np.linalg.qr(chebyshev(v, q, image, DEGREE, low, min(high, 0.999 * top), top))[0]


@dataclass
class Whitening:
    """What is fitted: n distinct vectors with their exact sums, eigenvalues and unit components, and how good they are."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int


def fit_whitening(vectors: DataFrame, wanted: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of column `x` (array of whole numbers, none null). None without vectors.

    Vectors of the most frequent length among the distinct ones are taken (ties: the longest). Components whose eigenvalue is zero in
    double precision are left out, so there may be fewer than `wanted`, or none if all vectors are equal.
    """
    spark = vectors.sparkSession
    path = scratch_path(spark, "whitening")
    vectors.select("x").distinct().mapInArrow(_pack, _PACKED).write.parquet(path)
    packed = spark.read.parquet(path)
    lengths = packed.groupBy("dimension").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dimension")).first()
    if lengths is None:
        return None
    dimension, n = lengths["dimension"], lengths["n"]
    blocks = packed.where(F.col("dimension") == dimension)
    sums = _sum_of_rows(blocks, dimension)
    v = Covariance(blocks, n, sums)
    values, components, residual = leading(v, wanted)
    kept = int((values > ZERO * v.trace).sum())
    values, components = values[:kept], components[:, :kept]
    components = components * np.where(components[np.abs(components).argmax(axis=0), range(kept)] < 0, -1.0, 1.0)
    error = 0.0
    if kept:
        white = components / np.sqrt(values)
        error = float(np.abs(white.T @ v.times(white) - np.eye(kept)).max())
    return Whitening(n, sums, values, components, v.trace, error, residual, v.passes)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum((n * x - S)^2) of each row, exact; None beyond the range of long."""
    most, total, squares = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1, max(map(abs, sums)) + 1, sum(s * s for s in sums)
    d = x.shape[1]
    exact = x if d * most * max(most, total) < 1 << 62 else x.astype(object)
    own, cross = (exact * exact).sum(axis=1), (exact * np.array(sums, dtype=exact.dtype if exact.dtype == object else np.int64)).sum(axis=1)
    out = [n * n * a - 2 * n * b + squares for a, b in zip(own.tolist(), cross.tolist())]
    return [v if v < 1 << 63 else None for v in out]


def whitened_rows(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE, wanted: int = COMPONENTS) -> DataFrame:
    """One row per row of `vectors` and component: key, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(scale * entry). The fit is over the n distinct x; deviation is sum((n x - S)^2) with their sums S, null
    if it exceeds a long. `whitened` is the centred x on the component over the root of its eigenvalue, `explained` the eigenvalue's
    share of the trace, `identity_error` how far the fitted rows' whitened covariance is from the identity. The entry of a component
    that is largest in size is positive. Rows whose vector is null, empty, of another length than most or holds null or non-finite
    entries are left out; null and repeated keys stay; equal vectors weigh once; without any spread there are no components and no rows.
    Other columns are not read.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = spread(vectors.select(F.col(key).alias("key"), scaled(F.col(column), scale).alias("x")).where("x IS NOT NULL"))
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [f.split()[0] for f in schema.split(", ")]
    fit = fit_whitening(rows, wanted)
    if fit is None or not len(fit.values):
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    mean, white = np.array([s / fit.n for s in fit.sums]), fit.components / np.sqrt(fit.values)
    explained, k = fit.values / fit.trace, len(fit.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _rows(batch.column(1)):
                if x.shape[1] != len(mean):
                    continue
                each = np.repeat(np.arange(len(part)), k)
                deviation = _deviations(x, fit.n, fit.sums)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(part[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                    pa.array(np.full(len(each), fit.n)), pa.array(deviation, pa.int64()).take(pa.array(each)),
                    pa.array(((x - mean) @ white).ravel()), pa.array(np.tile(explained, len(part))), pa.array(np.full(len(each), fit.identity_error)),
                ], names)

    return rows.mapInArrow(project, schema).withColumnRenamed("key", key)
