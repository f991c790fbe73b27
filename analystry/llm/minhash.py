"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal sets of word shingles form a class, and one signature stands for the class. Signatures that agree in a
band are candidates. Candidates are compared batch by batch; under a uniform prior for the similarity, a pair goes as soon as
the posterior probability of reaching the threshold falls below the chosen miss probability. Survivors are verified on the
full sets. Two sweeps over the buckets find the components. The first verifies each class's most similar partners; the second
marks the classes with surviving pairs that still join two components, brings their full sets into the buckets, and verifies every
such pair there. So no link between components is left out, and no bucket is written out as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from analystry.llm.components import connected_components, local_components
from analystry.llm.lookups import small_side
from analystry.llm.memory import frugal
from analystry.session import scratch_path, spread

WORDS_PER_SHINGLE = 5
#: Linked from this many hundredths of Jaccard similarity.
LEAST_PERCENT = 85
ROWS_PER_BAND = 5
#: Hashes compared before the posterior is looked at again.
BATCH = 20
#: A pair is dropped when the posterior probability of being similar enough is below this; a pair just similar enough shares no band with
#: no more than this probability.
MISS = 1e-6
#: Partners that the first sweep verifies for each class in each bucket; the second sweep takes all that are needed.
FIRST_PARTNERS = 2
#: Classes of one bucket that meet in one block; larger buckets are worked off in pairs of blocks.
BLOCK = 512
#: Shingles hashed at a time.
CHUNK = 4096
#: Pairs of a bucket below which sets are compared one by one, and bits that are compared at a time above that.
FEW_PAIRS, COLUMNS = 32, 1 << 15
#: What rows that meet have in common: band, its key, and the two blocks.
BUCKET = ("band", "key", "low", "high")

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def bands(percent: int) -> int:
    """The fewest bands of which a pair at `percent` shares none with probability MISS at most."""
    return ceil(log(MISS) / log1p(-((percent / 100) ** ROWS_PER_BAND)))


def hashes(percent: int) -> int:
    return bands(percent) * ROWS_PER_BAND


BANDS, HASHES = bands(LEAST_PERCENT), hashes(LEAST_PERCENT)


def shingle_set(text: str | None, width: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; A-Z lower-cased, words split at ASCII white space.

    Fewer words than `width` are one shingle, no words are an empty set.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    rolled = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        rolled = (rolled ^ hashed[k:len(words) - width + 1 + k]) * _STEP
        rolled ^= rolled >> np.uint64(31)
    return np.unique(rolled)


@lru_cache(maxsize=8)
def multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, count: int = HASHES) -> np.ndarray:
    """`count` minima over the set, 16 bits of each."""
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(shingles), CHUNK):
        np.minimum(least, np.multiply.outer(multipliers(count), shingles[first:first + CHUNK]).min(axis=1), out=least)
    return ((least * _MIX) >> np.uint64(48)).astype(np.uint16)


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the fewest equal hashes with which a pair goes on; posterior from a uniform prior, by quadrature."""
    grid = (np.arange(20000) + 0.5) / 20000
    above = grid >= percent / 100
    kept = []
    for n in range(BATCH, hashes(percent) + 1, BATCH):
        for m in range(n + 1):
            log_density = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log_density - log_density.max())
            if density[above].sum() >= miss * density.sum():
                break
        kept.append(m)
    return tuple(kept)


def _sketch(percent: int):
    count = hashes(percent)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text)
                sizes.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                sketches.append(signature(shingles, count).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "digest", "sketch"])

    return sketch


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text).tobytes() for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])


def survivors(bucket: np.ndarray, band: np.ndarray, cross: np.ndarray, side: np.ndarray, component: np.ndarray, sketch: np.ndarray,
              percent: int, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, equal hashes) of rows of one bucket that outlive every batch; rows are ordered by bucket.

    A pair counts in the first band that it shares only; in a pair of blocks only rows of different blocks meet; `across`
    leaves out pairs within a component. Rows meet row i + lag, one lag after another, for all buckets at once.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    needed = least_matches(percent)
    at, lag = np.arange(len(bucket)), 0
    while len(at):
        lag += 1
        at = at[at + lag < len(bucket)]
        at = at[bucket[at] == bucket[at + lag]]
        keep = ~cross[at] | (side[at] != side[at + lag])
        if across:
            keep &= component[at] != component[at + lag]
        i = at[keep]
        equal = np.zeros(len(i), np.int64)
        for step, least in enumerate(needed):
            part = slice(step * BATCH, (step + 1) * BATCH)
            equal = equal + (sketch[i, part] == sketch[i + lag, part]).sum(axis=1)
            alive = equal >= least
            i, equal = i[alive], equal[alive]
        if len(i):
            whole = (sketch[i] == sketch[i + lag]).reshape(len(i), bands(percent), ROWS_PER_BAND).all(axis=2)
            first = whole.argmax(axis=1) == band[i]
            found.append((i[first], i[first] + lag, equal[first]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _best_partners(i: np.ndarray, j: np.ndarray, equal: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the `most` best of one of their rows."""
    rows, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((pair, -equal[pair], rows))
    starts = np.flatnonzero(np.r_[True, rows[order][1:] != rows[order][:-1]])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return np.unique(pair[order[rank < most]])


def _by_bucket(work):
    """Arrow rows ordered by (band, key, low, high) to work(table of whole buckets), a batch's worth of buckets at a time."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]) if held is not None else rows
            key = [held.column(c).to_numpy() for c in BUCKET]
            last = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
            if len(last):
                yield work(held.slice(0, last[-1] + 1))
                held = held.slice(last[-1] + 1)
        if held is not None:
            yield work(held)

    return sweep


def _surviving(rows: pa.Table, percent: int, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    band, key, low, high, side, component = (rows.column(c).to_numpy() for c in (*BUCKET, "side", "component"))
    new = np.r_[True, (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(rows.num_rows, hashes(percent))
    return survivors(np.cumsum(new), band, low != high, side, component, sketch, percent, across)


def _partners(percent: int):
    """Whole buckets to pairs (a, b): each row's FIRST_PARTNERS most similar survivors."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        i, j, equal = _surviving(rows, percent, False)
        chosen = _best_partners(i, j, equal, FIRST_PARTNERS) if len(i) else i
        ids = rows.column("id").to_numpy()
        a, b = ids[i[chosen]], ids[j[chosen]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return work


def _marks(percent: int):
    """Whole buckets to their rows that survive with a row of another component, without signatures."""
    names = (*BUCKET, "side", "id", "component")

    def work(rows: pa.Table) -> pa.RecordBatch:
        i, j, _ = _surviving(rows, percent, True)
        marked = np.unique(np.concatenate([i, j]))
        return pa.RecordBatch.from_arrays([pa.array(rows.column(c).to_numpy()[marked]) for c in names], list(names))

    return work


def _exact_links(percent: int):
    """Whole buckets of marked rows with their shingle sets to links (a, b) between components, a forest for each bucket."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        i, j, _ = _surviving(rows, percent, True)
        order = np.argsort(i, kind="stable")  # rows are ordered by bucket, and so are pairs by their first row
        i, j = i[order], j[order]
        component, packed = rows.column("component").to_numpy(), rows.column("shingles")
        key = np.column_stack([rows.column(c).to_numpy() for c in BUCKET])
        starts = np.flatnonzero(np.r_[len(i) > 0, (key[i[1:]] != key[i[:-1]]).any(axis=1), len(i) > 0]) if len(i) else []
        links = [np.zeros((0, 2), np.int64)]
        for low, high in zip(starts[:-1], starts[1:]):
            used, at = np.unique(np.concatenate([i[low:high], j[low:high]]), return_inverse=True)
            sets = [np.frombuffer(packed[int(n)].as_buffer(), np.uint64) for n in used]
            left, right = at[:high - low], at[high - low:]
            linked = similar_pairs(sets, left, right, percent)
            nodes, place = np.unique(component[used], return_inverse=True)
            label = local_components(place[left[linked]], place[right[linked]], len(nodes))
            joined = np.flatnonzero(label != np.arange(len(nodes)))
            links.append(np.column_stack([nodes[joined], nodes[label[joined]]]))
        links = np.concatenate(links)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return work


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (left, right) of sorted sets have 100 * intersection >= percent * union.

    Shingles that two sets or more hold become bits, COLUMNS at a time; a pair's intersection is the count of its common bits.
    """
    if len(left) < FEW_PAIRS:
        return np.array([similar(sets[a], sets[b], percent) for a, b in zip(left, right)], bool)
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    owner, column = owner[shared], (np.cumsum(held > 1) - 1)[column[shared]]
    both = np.zeros(len(left), np.int64)
    for first in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        part = (column >= first) & (column < first + COLUMNS)
        bits = np.zeros((len(sets), COLUMNS), bool)
        bits[owner[part], column[part] - first] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(0, len(left), 1024):
            both[k:k + 1024] += np.bitwise_count(words[left[k:k + 1024]] & words[right[k:k + 1024]]).sum(axis=1, dtype=np.int64)
    return 100 * both >= percent * (sizes[left] + sizes[right] - both)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _bucket_rows(classes: DataFrame, percent: int) -> DataFrame:
    """(band, key, digest, n) of classes whose band key another class has too."""
    band = F.explode(F.sequence(F.lit(0), F.lit(bands(percent) - 1))).alias("band")
    keys = classes.select("digest", "sketch", band).select(
        "digest", "band", F.xxhash64("band", F.substring("sketch", F.col("band") * (2 * ROWS_PER_BAND) + 1, F.lit(2 * ROWS_PER_BAND))).alias("key"))
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    return keys.join(shared, ["band", "key"])


def _placed(members: DataFrame, classes: DataFrame, components: DataFrame | None) -> DataFrame:
    """Bucket members with signature and component, ordered by bucket; buckets above BLOCK are cut into pairs of blocks."""
    labelled = members.join(classes, "digest")
    if components is None:
        labelled = labelled.withColumn("component", F.col("id"))
    else:
        labelled = labelled.join(components.select(F.col("node").alias("id"), "component"), "id", "left").withColumn(
            "component", F.coalesce("component", "id"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = labelled.withColumn("side", F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = placed.select("band", "key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "id", "component", "sketch")
    return _in_buckets(rows)


def _in_buckets(rows: DataFrame) -> DataFrame:
    return rows.repartition(*BUCKET).sortWithinPartitions(*BUCKET, "id")


def _shingles_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles) of the wanted ids."""
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(small_side(wanted), "id")
    return texts.dropDuplicates(["id", "text"]).mapInArrow(frugal(_sets), "id long, shingles binary")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full shingle sets."""
    sets = _shingles_of(docs, pairs.select("a").unionAll(pairs.select("b")).select(F.col("a").alias("id")).distinct())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                    for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())]
            chosen = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(chosen), batch.column("b").take(chosen)], ["a", "b"])

    with_left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
    with_both = with_left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
    return with_both.select("a", "b", "left", "right").mapInArrow(verify, "a long, b long")


def _written(rows: DataFrame, label: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def near_duplicates(docs: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links; the kept document of a component is the one with that id. Null
    and empty texts have no shingles and are linked with nothing. Rows that repeat doc_id and text share their result; a doc_id
    with several texts is linked if any of them is, and each row gets the component of its own text. Rows without doc_id are a component of their own
    (null) and are not kept. Texts of any length are read whole; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = _written(spread(rows).mapInArrow(frugal(_sketch(percent)), "doc_id long, n_shingles long, digest binary, sketch binary"), "sketches")
    classes = _written(sketched.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("sketch").alias("sketch")), "classes")
    members = _written(_bucket_rows(classes, percent), "buckets")
    pairs = _placed(members, classes, None).mapInArrow(frugal(_by_bucket(_partners(percent))), "a long, b long").distinct()
    first = _written(_verified(_written(pairs, "pairs"), rows, percent), "links")
    components = _written(connected_components(first), "components")
    marks = "band int, key long, low int, high int, side int, id long, component long"
    marked = _written(_placed(members, classes, components).mapInArrow(frugal(_by_bucket(_marks(percent))), marks), "marked")
    sets = _shingles_of(rows, marked.select("id").distinct())
    exact = _in_buckets(marked.join(classes.select("id", "sketch"), "id").join(sets, "id").select(
        *BUCKET, "side", "id", "component", "sketch", "shingles"))
    later = exact.mapInArrow(frugal(_by_bucket(_exact_links(percent))), "a long, b long")
    links = components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(later)
    final = _written(connected_components(_written(links, "links")), "components")
    named = classes.select("digest", "id").join(final.select(F.col("node").alias("id"), "component"), "id", "left").select(
        "digest", F.coalesce("component", "id").alias("component_id"))
    joined = sketched.select("doc_id", "n_shingles", "digest").join(_written(named, "named"), "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """`docs` with all its columns and one document of each component: the one with the smallest doc_id.

    Of rows that repeat a kept doc_id one stays. Rows without doc_id cannot be told apart and stay.
    """
    judged = _written(near_duplicates(docs, percent).select("doc_id", "kept"), "kept")
    dropped = judged.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    # the columns travel as one, so that no name can clash
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = rows.join(small_side(dropped.where("NOT kept").select(F.col("doc_id").alias("id"))), "id", "left_anti")
    repeated = dropped.where("kept AND n > 1").select(F.col("doc_id").alias("id"))
    if not repeated.isEmpty():
        out = out.join(small_side(repeated), "id", "left_anti").unionByName(out.join(small_side(repeated), "id", "left_semi").dropDuplicates(["id"]))
    return out.select("row.*")
