"""Substring deduplication by content-defined chunks.

A gear rolling hash cuts every text where the last 32 bytes say so, hence a passage is cut alike in all documents but for its first
chunks, whatever was inserted before it. Chunks are compared by digest over all documents; runs of neighbouring chunks that stand
in other documents too are the repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from analystry.llm.chunking import chunk_bounds
from analystry.session import scratch_path, spread

#: Least, usual (least plus two to this power) and greatest bytes of a chunk: about six words.
CHUNK_LEAST, CHUNK_BITS, CHUNK_MOST = 16, 4, 96
#: A run of repeated chunks counts from this many words. A passage of fifty words loses its first chunks, up to where the cuts agree, and
#: part of its last; what is left of it is above this.
LEAST_WORDS = 25
#: Chunk rows that a task returns at a time.
RETURNED = 1 << 16


def text_chunks(text: str) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(digests, starts, ends, word starts) of a text's chunks; places in code points."""
    data = text.encode()
    ends = np.array(chunk_bounds(data, CHUNK_LEAST, CHUNK_BITS, CHUNK_MOST), np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    digests = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
    octets = np.frombuffer(data, np.uint8)
    blank = (octets == 32) | ((octets >= 9) & (octets <= 13))
    words = np.concatenate([[0], np.cumsum(~blank & np.concatenate([[True], blank[:-1]]) if len(octets) else blank)])
    letters = np.concatenate([[0], np.cumsum((octets & 0xC0) != 0x80)])
    return digests, letters[starts], letters[ends], words[ends] - words[starts]


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["digest", "doc_id", "start", "end", "words"]

    def packed(held):
        digests = np.concatenate([np.array(h[0], np.uint64) for h in held]).view(np.int64)
        ids = np.concatenate([np.full(len(h[0]), h[1], np.int64) for h in held])
        rest = [np.concatenate([h[k] for h in held]).astype(np.int32) for k in (2, 3, 4)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (digests, ids, *rest)], names)

    held, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            digests, *rest = text_chunks(text)
            held.append((digests, doc_id, *rest))
            size += len(digests)
            if size >= RETURNED:
                yield packed(held)
                held, size = [], 0
    if size:
        yield packed(held)


def _parts(doc_id: int, run: list[dict]) -> Iterator[tuple]:
    """A run's rows, cut where kept changes.

    A passage that a smaller doc_id holds too is one stretch of chunks first seen elsewhere; a stretch below LEAST_WORDS is none and stays
    with the chunks around it. Chunks first seen here are never in a row that is not kept; too few of them are no passage and get no row.
    """
    stretches = [(kept, list(part)) for kept, part in groupby(run, lambda c: c["first_doc"] == doc_id)]
    sized = [(kept or sum(c["words"] for c in part) < LEAST_WORDS, part) for kept, part in stretches]
    for kept, parts in groupby(sized, lambda x: x[0]):
        held = [c for _, part in parts for c in part]
        words = sum(c["words"] for c in held)
        if words >= LEAST_WORDS:
            yield doc_id, held[0]["start"], held[-1]["end"], words, len(held), doc_id if kept else min(c["first_doc"] for c in held), kept


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, sorted repeated chunks) to the parts of runs of neighbouring chunks with LEAST_WORDS words or more."""
    for batch in batches:
        rows = []
        for doc_id, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            run: list[dict] = []
            for chunk in [*chunks, None]:
                if run and (chunk is None or chunk["start"] > run[-1]["end"]):
                    if sum(c["words"] for c in run) >= LEAST_WORDS:
                        rows += _parts(doc_id, run)
                    run = []
                if chunk is not None and not (run and chunk["start"] == run[-1]["start"]):
                    run.append(chunk)
        columns = list(zip(*rows)) if rows else [[] for _ in range(7)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "start", "end", "words", "chunks", "first_doc_id", "kept"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per passage of `docs` (doc_id, text) that stands in other documents too: doc_id, start, end, words, chunks,
    first_doc_id, kept.

    Places are code points of the whole text, ends exclusive. `kept` marks the passages of the document with the
    smallest doc_id of all that hold them; the others may be cut out. A run that mixes both is two rows
    or more, so every chunk stays in its first document. first_doc_id is the smallest of a row's chunks, the document itself if kept. What a document repeats of itself only is left alone. Passages of fewer than LEAST_WORDS words in common chunks are left alone. Null and
    empty texts and rows without doc_id have none; rows that repeat a doc_id count as one document; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = spread(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    path = scratch_path(spark, "chunks")
    rows.mapInArrow(_chunk_rows, "digest long, doc_id long, start int, end int, words int").write.parquet(path)
    chunks = spark.read.parquet(path)
    held = chunks.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc <> last_doc")
    shared = scratch_path(spark, "shared-chunks")
    held.select("digest", "first_doc").write.parquet(shared)
    found = chunks.join(spark.read.parquet(shared), "digest")
    per_document = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "words", "first_doc"))).alias("chunks"))
    return per_document.mapInArrow(_runs, "doc_id long, start int, end int, words int, chunks int, first_doc_id long, kept boolean")


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with all its columns and every passage that is not kept cut out of `text`."""
    cuts = repeated_passages(docs).where("NOT kept").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    # the columns travel as one, so that no name can clash
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = rows.join(cuts.withColumnRenamed("doc_id", "id"), "id", "left").select("row", "cuts")
    names, place = docs.columns, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = batch.column(0).flatten(), []
            for text, spans in zip(columns[place].to_pylist(), batch.column(1).to_pylist()):
                for span in reversed(spans or []):
                    text = text[:span["start"]] + text[span["end"]:]
                texts.append(text)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(cut, docs.schema)
