"""Quality by hierarchical empirical Bayes.

A classifier on the shape of a document gives its evidence as a log-odds. Documents of one host, and of one path of a host, share a rate
of good documents. The rates are estimated by grouped sums of what is known of their documents, the global rate being the prior of
hosts and a host's posterior the prior of its paths; the weights of the priors come from the spread of the rates themselves. Sites
with few documents so stay near the rate above them. A document's score adds its own evidence to the odds of its path.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from analystry.llm.toxicity import fold
from analystry.session import scratch_path, spread

#: Labelled rows that the classifier is fitted on at most, those with the least hash of doc_id.
TRAIN_ROWS = 1 << 16
#: Documents are kept from this posterior probability of being good.
KEEP_FROM = 0.5
#: Bounds of a prior's weight in documents.
WEIGHT_LEAST, WEIGHT_MOST = 2.0, 1000.0

FEATURES = ("letters", "digits", "blanks", "marks", "symbols", "upper", "word_length", "long_words", "lone_words", "distinct_words",
            "repeated_lines", "line_words", "packed", "length", "sentence_ends")


def shape(text: str | None) -> list[float]:
    """Numbers that describe how a text is written, of the whole text; all 0 for a text without words."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    size = len(text)
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    digits = sum(map(len, re.findall(r"\d+", text)))
    blanks = size - sum(map(len, words))
    marks = len(re.findall(r"[.,;:!?'\"()-]", text))
    symbols = max(0, size - letters - digits - blanks - marks)
    upper = sum(map(len, re.findall(r"[A-ZÄÖÜÉÈÊÀÇÑÁÍÓÚ]+", text)))
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    count = len(words)
    data = text.encode()
    packed = len(zlib.compress(data, 1)) / len(data)
    ends = len(re.findall(r"[.!?](?:\s|$)", text))
    return [
        letters / size, digits / size, blanks / size, marks / size, symbols / size, upper / size, (size - blanks) / count / 10,
        sum(len(w) > 12 for w in words) / count, sum(not any(c.isalpha() for c in w) for w in words) / count, len(set(words)) / count,
        1 - len(set(lines)) / len(lines), min(1.0, count / len(lines) / 50), min(1.5, packed), np.log1p(count) / 10, ends / count,
    ]


def _design(rows: np.ndarray) -> np.ndarray:
    """The features, their squares and logarithms."""
    return np.column_stack([np.ones(len(rows)), rows, rows ** 2, np.log(rows + 0.01)])


class Evidence:
    """A ridge-penalised logistic curve, less the base rate: the log-odds that a document's own shape adds."""

    def __init__(self, shapes: np.ndarray, good: np.ndarray):
        design = _design(shapes if len(shapes) else np.zeros((1, len(FEATURES))))
        self.mean, self.spread = design.mean(axis=0), design.std(axis=0) + 1e-9
        self.mean[0], self.spread[0] = 0.0, 1.0
        design = ((design - self.mean) / self.spread)[:len(shapes)]
        rate = (good.sum() + 0.5) / (len(good) + 1)
        self.base = float(np.log(rate / (1 - rate)))
        self.weight = np.zeros(design.shape[1])
        self.weight[0] = self.base
        penalty = np.full(design.shape[1], 0.1)
        penalty[0] = 0.0
        if 0 < good.sum() < len(good):
            for _ in range(60):
                p = 1 / (1 + np.exp(-np.clip(design @ self.weight, -30, 30)))
                hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty) + 1e-9 * np.eye(len(penalty))
                step = np.linalg.solve(hessian, design.T @ (good - p) - penalty * self.weight)
                self.weight += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
                if np.abs(step).max() < 1e-7:
                    break

    def __call__(self, shapes: np.ndarray) -> np.ndarray:
        return np.clip(((_design(shapes) - self.mean) / self.spread) @ self.weight - self.base, -20, 20)


def fit_evidence(docs: DataFrame, labels: DataFrame) -> Evidence:
    """The classifier, from at most TRAIN_ROWS labelled documents outside fold 0; null labels are left out."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").alias("labelled_id")).agg(F.min(F.col("quality").cast("int")).alias("good"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(TRAIN_ROWS))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, F.col("doc_id") == F.col("labelled_id"))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.array([shape(t) for t in batch.column(1).to_pylist()], np.float32).reshape(batch.num_rows, len(FEATURES))
            good = batch.column(2).to_numpy().astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([data, good]).tobytes()], pa.binary())], ["rows"])

    packed = spread(rows.select("doc_id", "text", "good")).mapInArrow(shapes, "rows binary")
    data = np.concatenate([np.zeros((0, len(FEATURES) + 1), np.float32)] + [np.frombuffer(r["rows"], np.float32).reshape(-1, len(FEATURES) + 1) for r in packed.collect()])
    data = data[np.lexsort(data.T)].astype(np.float64)  # the order in which tasks end must not show
    return Evidence(data[:, :-1], data[:, -1])


def _prior_weight(groups: DataFrame) -> float:
    """Weight in documents of the prior of (n, good, prior) rows, by moments of the groups' rates about their priors."""
    p = F.col("prior")
    seen = groups.agg(
        F.count("*"), F.sum(F.pow(F.col("good") - F.col("n") * p, 2) / (p * (1 - p))).alias("chi"), F.sum("n").alias("n"), F.sum(F.pow("n", 2)).alias("square")).first()
    if not seen[0] or not seen["n"]:
        return WEIGHT_MOST
    # E[(good - n p)^2] = p (1 - p) (n + n (n - 1) / (weight + 1))
    over = (seen["chi"] - seen["n"]) / max(seen["square"] - seen["n"], 1.0)
    return float(np.clip(1 / over - 1 if over > 0 else WEIGHT_MOST, WEIGHT_LEAST, WEIGHT_MOST))


def quality_posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source, lang): doc_id, held_out, host, path, evidence, host_rate, path_rate,
    score, kept.

    The host is `source` up to its first slash, the path its rest and the language of the document. Null sources are a host of their
    own; null and empty texts have the evidence of a text without words; rows that repeat are judged each. Labels enter through
    the classifier only; host and path rates come from the evidence of all documents. With labels of one kind only, the evidence is 0.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(fit_evidence(docs, labels))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = np.array([shape(t) for t in batch.column(0).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sent.value(shapes), pa.float64())], ["doc_id", "host", "path", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    host = F.substring_index("source", "/", 1)
    path = F.concat_ws("/", F.when(F.contains("source", F.lit("/")), F.expr("substring(source, instr(source, '/') + 1)")), "lang")
    rows = spread(docs.select(F.col("text").cast("string").alias("text"), "doc_id", host.alias("host"), path.alias("path")))
    written = scratch_path(spark, "evidence")
    rows.mapInArrow(judge, f"doc_id {kind}, host string, path string, evidence double").write.parquet(written)
    judged = spark.read.parquet(written)
    base = sent.value.base
    good = 1 / (1 + F.exp(-(F.col("evidence") + base)))
    paths = judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(good).alias("good"))
    table = scratch_path(spark, "paths")
    paths.write.parquet(table)
    paths = spark.read.parquet(table)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    overall = float(np.clip(total[1] / total[0] if total[0] else 0.5, 1e-3, 1 - 1e-3))
    hosts = hosts.withColumn("prior", F.lit(overall))
    weight = _prior_weight(hosts)
    rates = hosts.select(F.col("host").alias("of_host"), ((F.col("good") + weight * overall) / (F.col("n") + weight)).alias("host_rate"))
    inside = paths.join(rates, F.col("host").eqNullSafe(F.col("of_host"))).withColumn("prior", F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("host_rate"))))
    weight = _prior_weight(inside)
    both = inside.select("of_host", F.col("path").alias("of_path"), "host_rate", ((F.col("good") + weight * F.col("prior")) / (F.col("n") + weight)).alias("path_rate"))
    posteriors = scratch_path(spark, "rates")
    both.write.parquet(posteriors)
    joined = judged.join(spark.read.parquet(posteriors), F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")), "left")
    rate = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("path_rate")))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(rate / (1 - rate)))))
    return joined.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "host", "path", "evidence", "host_rate", "path_rate",
                         score.alias("score")).withColumn("kept", F.col("score") >= KEEP_FROM)
