"""Toxicity by maximum-scoring segments.

Words get log-odds of standing in toxic documents. Counts are smoothed along a chain of Dirichlet priors: the classes' base rate is
the prior of a word's first four letters, these are the prior of its first five, and so on up to the word. Less a constant drift,
the scores of a text's words make a walk, whose maximal segments (Ruzzo and Tompa, linear time) are its most toxic passages.
The best scores of clean texts follow an extreme-value law in the logarithm of the length; what a text's segments exceed it by
is what a two-term logistic curve turns into a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from analystry.llm.memory import frugal
from analystry.session import scratch_path, spread

WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
#: Slots of the hashed counts: two numbers each are sent to every task.
SLOTS = 1 << 20
#: Labelled rows that are learned from at most, those with the least hash of doc_id; they are broadcast.
TRAIN_ROWS = 1 << 17
#: Weight of the prior in documents, what every word's score is lowered by, and bounds of a word's log-odds.
PRIOR, DRIFT, FLOOR, CEILING = 8.0, 1.2, -2.0, 6.0
#: Words whose scores a task remembers.
REMEMBERED = 1 << 18


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out, fold 4 fits the curve, the others the words."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def slots_of(word: str) -> list[int]:
    """The word's chain of slots, from its shortest counted prefix to itself."""
    keys = [f"{n}^{word[:n]}" for n in PREFIXES if len(word) > n] + [word]
    return [xxhash.xxh64_intdigest(k) % SLOTS for k in keys]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum), ends exclusive, in linear time.

    Runs between words of positive score are summed first, so that the loop is over those words only.
    """
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before the start, sum at the end
    before: list[int] = []  # for each segment, the last one under it with a smaller sum before the start; -1 if none
    for at in places.tolist():
        start, end, low, high = at, at + 1, float(sums[at]), float(sums[at + 1])
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:
                k = before[k]
            if k < 0 or stack[k][3] >= high:
                stack.append((start, end, low, high))
                before.append(k)
                break
            start, low = stack[k][0], stack[k][2]
            del stack[k:], before[k:]
    return [(a, b, high - low) for a, b, low, high in stack]


@dataclass
class ToxicityModel:
    """Hashed document counts, the extreme-value law of clean texts and the final curve."""

    toxic: np.ndarray
    clean: np.ndarray
    documents: tuple[int, int]
    scale: float = 1.0
    offset: float = 0.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __post_init__(self):
        toxic, clean = self.documents
        self.base = (toxic + 0.5) / (toxic + clean + 1)
        self.memory: dict[str, float] = {}

    def word_score(self, word: str) -> float:
        known = self.memory.get(word)
        if known is None:
            share = self.base
            for slot in slots_of(word):
                hit, miss = self.toxic[slot], self.clean[slot]
                share = (hit + PRIOR * share) / (hit + miss + PRIOR)
            odds = np.log(share / (1 - share)) - np.log(self.base / (1 - self.base))
            known = float(min(max(odds, FLOOR), CEILING)) - DRIFT
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[word] = known
        return known

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        words = words_of(text)
        return maximal_segments(np.fromiter(map(self.word_score, words), np.float64, len(words))), len(words)

    def excess(self, score: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Minus the logarithm of how many such segments a clean text of this length would have."""
        return self.scale * score - np.log(length + 1.0) - self.offset

    def terms(self, segments: list[tuple[int, int, float]], length: int) -> tuple[float, float]:
        """The best segment's excess, and the sum of all further significant ones."""
        if not segments:
            return float(self.excess(np.array(0.0), np.array(length))), 0.0
        excess = np.sort(self.excess(np.array([s for _, _, s in segments]), np.array(length)))[::-1]
        return float(excess[0]), float(np.log1p(np.maximum(excess[1:], 0).sum()))

    def probability(self, terms: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * terms[:, 0] + c * terms[:, 1], -30, 30)))

    def fit_law(self, label: np.ndarray, best: np.ndarray, length: np.ndarray) -> None:
        """The law of clean texts by moments, from the best segment's sum and the number of words of fresh labelled texts."""
        clean = label == 0
        if clean.sum() > 1:
            for _ in range(20):
                rest = best[clean] - np.log(length[clean] + 1) / self.scale
                self.scale = float(np.clip(np.pi / np.sqrt(6) / max(rest.std(), 1e-6), 0.2, 5.0))
            self.offset = float(self.scale * rest.mean() - np.euler_gamma)

    def fit_curve(self, label: np.ndarray, terms: np.ndarray) -> None:
        """The curve by Newton steps, from both terms of fresh labelled texts."""
        design = np.column_stack([np.ones(len(terms)), terms])
        weight = np.array([np.log(self.base / (1 - self.base)), 0.0, 0.0])
        if 0 < label.sum() < len(label):
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(design @ weight, -30, 30)))
                gradient = design.T @ (label - p) - 1e-2 * np.array([0, weight[1], weight[2]])
                hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(3)
                step = np.linalg.solve(hessian, gradient)
                weight = weight + np.clip(step, -2, 2)
                if np.abs(step).max() < 1e-8:
                    break
        self.curve = tuple(float(w) for w in weight)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) rows to (slot, toxic, clean): documents that hold each slot's words; slot SLOTS counts the documents."""
    counts = np.zeros((2, SLOTS + 1), np.int64)
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            slots = {s for word in set(words_of(text)) for s in slots_of(word)} | {SLOTS}
            counts[1 - toxic, list(slots)] += 1
    used = np.flatnonzero(counts.any(axis=0))
    for first in range(0, len(used), 1 << 16):
        part = used[first:first + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[0, part]), pa.array(counts[1, part])], ["slot", "toxic", "clean"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.column_stack([batch.column(k).to_numpy() for k in range(3)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], ["rows"])


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model of `labels.toxic` from (doc_id, text) and (doc_id, toxic); fold 0 is not looked at.

    Null labels and ids are left out; a doc_id with several labels counts as toxic if one is. At most TRAIN_ROWS labelled
    documents are used, so that their ids can be broadcast and texts need no shuffle.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(TRAIN_ROWS))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, F.col("doc_id") == F.col("labelled_id"))
    words = spread(rows.where(fold(F.col("doc_id")) != 4).select("toxic", "text")).mapInArrow(frugal(_counted), "slot long, toxic long, clean long")
    counts = np.zeros((2, SLOTS + 1), np.int64)
    summed = words.groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    for row in summed.mapInArrow(_packed, "rows binary").toLocalIterator():
        part = np.frombuffer(row["rows"], np.int64).reshape(-1, 3)
        counts[:, part[:, 0]] = part[:, 1:].T
    model = ToxicityModel(counts[0, :SLOTS].astype(np.int32), counts[1, :SLOTS].astype(np.int32), (int(counts[0, SLOTS]), int(counts[1, SLOTS])))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.segments(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("toxic"), pa.array([[s for _, _, s in segments] for segments, _ in found], pa.list_(pa.float64())),
                pa.array([n for _, n in found], pa.int64())], ["toxic", "sums", "words"])

    seen = spread(rows.where(fold(F.col("doc_id")) == 4).select("toxic", "text")).mapInArrow(frugal(fresh), "toxic int, sums array<double>, words long")
    path = scratch_path(docs.sparkSession, "segments")
    seen.write.parquet(path)
    sent.destroy()
    seen = docs.sparkSession.read.parquet(path).withColumn("best", F.coalesce(F.array_max("sums"), F.lit(0.0)))
    law = np.array(sorted(map(tuple, seen.select("toxic", "best", "words").collect())), float).reshape(-1, 3)  # TRAIN_ROWS rows at most, as below
    model.fit_law(*law.T)

    def excess(score: Column) -> Column:
        return F.lit(model.scale) * score - F.log(F.col("words") + 1.0) - F.lit(model.offset)

    every = F.aggregate("sums", F.lit(0.0), lambda total, s: total + F.greatest(excess(s), F.lit(0.0)))
    rest = F.log1p(F.greatest(every - F.greatest(excess(F.col("best")), F.lit(0.0)), F.lit(0.0)))
    fitted = np.array(sorted(map(tuple, seen.select("toxic", excess(F.col("best")), rest).collect())), float).reshape(-1, 3)
    model.fit_curve(fitted[:, 0], fitted[:, 1:])
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score, predicted, and the best segment as
    `segment_score`, `segment_start`, `segment_end` (in words).

    Null and empty texts have no words: their score is the curve's value for no evidence. Whole texts are scored; ties
    between segments go to the first; rows that repeat are scored each; a null doc_id is not held out. Without labels of both
    kinds the score is the base rate. Only `text` enters a score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, terms, best = sent.value, [], []
            for text in batch.column("text").to_pylist():
                segments, length = model.segments(text)
                terms.append(model.terms(segments, length))
                best.append(max(segments, key=lambda s: (s[2], -s[0]), default=(None, None, 0.0)))
            p = model.probability(np.array(terms).reshape(len(terms), 2))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                pa.array([b[2] for b in best], pa.float64()), pa.array([b[0] for b in best], pa.int32()), pa.array([b[1] for b in best], pa.int32())],
                ["doc_id", "held_out", "score", "predicted", "segment_score", "segment_start", "segment_end"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(frugal(score), f"doc_id {kind}, held_out boolean, score double, predicted int, segment_score double, segment_start int, segment_end int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with all its columns, without the documents that are predicted to be toxic. Texts are read in place, not joined.

    Without labels of both kinds nothing tells toxic texts apart, and all documents stay.
    """
    learnt = learn(docs, labels)
    if not all(learnt.documents):
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(learnt)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = sent.value
            terms = [model.terms(*model.segments(text)) for text in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            keep = model.probability(np.array(terms).reshape(len(terms), 2)) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(frugal(clean), docs.schema)
