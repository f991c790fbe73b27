"""From raw documents to token counts of a mix: five stages, each written as Parquet and read again by the next.

Toxic documents go; one document of each group of near-duplicates stays; personal data is masked; sources are mixed to their target
weights, so that documents of heavy sources come up to three times and some of light ones not at all; what is left is encoded.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from analystry.llm import bpe, minhash, mixing, pii, toxicity
from analystry.llm.queries import tokenizer_file
from analystry.session import scratch_path, table


#: Documents of this many hundredths of Jaccard similarity over word shingles are near-duplicates here; op8 asks for more.
NEAR_PERCENT = 80


#: Bytes of a batch that Spark hands to a Python worker: the workers of all stages stay small. Spark's own setting is for one stage alone.
BATCH_BYTES = 4 << 20


def in_small_batches(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        return stage(spark, docs, sf_dir)

    return run_stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, NEAR_PERCENT)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_file())


STAGES = [
    ("toxicity", in_small_batches(drop_toxic)),
    ("near_duplicates", in_small_batches(drop_near_duplicates)),
    ("personal_data", in_small_batches(mask_personal_data)),
    ("source_mix", in_small_batches(mix_sources)),
    ("bpe_tokens", in_small_batches(encode)),
]

#: Signatures, toxicity curves and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; one row per document of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
