"""Text features in long form: (document, term, weight) rows instead of a matrix.

A document's terms are counted where its row is, so texts are not shuffled. What several steps read, the
(document, term, tf) rows or the weights made from them, is written once (`kept`) and never formed again.
Document frequencies are summed in the map tasks before they are shuffled by term.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from analystry.functions import text as T
from analystry.operators.ordering import ordered_index
from analystry.operators.quantiles import scalars
from analystry.operators.run_counts import Runs, counter, document_counter, known_counts, weigher
from analystry.session import cut_lineage, scratch_path, spread

#: Texts whose vectors are made together, on average.
SHARD_TEXTS = 256
#: Frequent short runs that are sent to the tasks.
MOST_MARKERS = 8192
#: Terms of a vocabulary that are sent to the tasks.
MOST_TERMS = 1 << 16


def term_counts(docs: DataFrame, keys: Sequence[str], terms: Column | Runs) -> DataFrame:
    """(keys..., term, tf) of the runs, or of an array of terms without nulls, per document; one row of docs is one document."""
    runs = terms if isinstance(terms, Runs) else Runs(terms)
    placed = spread(docs, *keys).select(*keys, runs.items.alias("_items"))
    schema = StructType([*placed.select(*keys).schema.fields, StructField("term", StringType()), StructField("tf", LongType())])
    return placed.mapInArrow(counter(runs), schema)


def document_frequencies(docs: DataFrame, runs: Runs) -> DataFrame:
    """(term, df): how many rows of docs have each run; a task hands on one row per run and stretch of documents."""
    parts = spread(docs).select(F.lit(0).alias("_all"), runs.items.alias("_items")).mapInArrow(document_counter(runs), "_all int, term string, df long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


def joined_runs(items: Column, low: int, high: int, glue: str) -> Column:
    """The array of all runs of low..high neighbouring entries of an array without null entries, joined; the short ones first."""

    def join(arrays: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values, document = arrays.flatten(), np.repeat(np.arange(len(sizes)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(values))
        texts, places = [pa.array([], pa.string())], [np.zeros(0, np.int64)]
        for n in range(low, high + 1):
            start = np.flatnonzero(left >= n)
            words = [values.take(pa.array(start + k)) for k in range(n)]
            texts.append((words[0] if n == 1 else pc.binary_join_element_wise(*words, glue)).cast(pa.string()))
            places.append(document[start])
        place = np.concatenate(places)
        ends = np.cumsum(np.bincount(place, minlength=len(sizes)))
        found = pa.concat_arrays(texts).take(pa.array(np.argsort(place, kind="stable")))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), found)

    return F.arrow_udf(join, ArrayType(StringType()))(items)


def kept(rows: DataFrame, label: str = "terms") -> DataFrame:
    """The same rows, written below the shared folder: every later step reads only the columns it needs."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def frequent_runs(docs: DataFrame, items: Column, low: int, high: int, glue: str, marker: int, min_df: float) -> Runs:
    """The runs of low..high items of a document, less those that cannot be in a share of min_df of the documents.

    A run is in no more documents than any run of `marker` items inside it, so only the short runs are counted over all
    documents first; the many rare long ones are then neither formed nor shuffled. There are at most (mean distinct
    short runs per document) / min_df frequent ones, however many documents there are; beyond MOST_MARKERS they are
    not sent to the tasks and every run is formed, which gives the same vocabulary.
    """
    n = docs.count()
    found = (document_frequencies(docs, Runs(items, marker, marker, glue))
             .where(F.col("df") >= F.lit(float(n)) * min_df).select("term").limit(MOST_MARKERS + 1).collect())
    if len(found) > MOST_MARKERS:
        return Runs(items, low, high, glue)
    return Runs(items, low, high, glue, marker, sorted(r["term"] for r in found))


def char_terms(column: str | Column, low: int = 2, high: int = 5) -> Runs:
    return Runs(F.col(column) if isinstance(column, str) else column, low, high)


def word_terms(column: str, low: int = 1, high: int = 3, lowercase: bool = False) -> Runs:
    text = F.lower(column) if lowercase else F.col(column)
    return Runs(T.word_tokens(text), low, high, " ")


def plain_words(column: str, stop_words: Sequence[str] = ()) -> Column:
    """Lower-case tokens without the stop words."""
    return F.filter(T.word_tokens(F.lower(column)), lambda w: ~w.isin(list(stop_words))) if stop_words else T.word_tokens(F.lower(column))


def vocabulary(counts: DataFrame, docs: DataFrame, by: Sequence[str] = (), min_df: float = 0.0,
               max_df: float = 1.0) -> DataFrame:
    """(by..., term, df, n): terms whose share of documents lies between min_df and max_df.

    With a positive min_df there are at most (mean distinct terms per document) / min_df terms,
    however many documents there are.
    """
    found = counts.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    if by:
        found = found.join(docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), list(by))
    else:
        found = found.withColumn("n", scalars(docs.agg(F.count(F.lit(1)).alias("n")))["n"])
    return found.where((F.col("df") >= F.col("n") * min_df) & (F.col("df") <= F.col("n") * max_df))


def run_vocabulary(docs: DataFrame, runs: Runs, by: str, key: str, min_df: float = 0.0) -> DataFrame:
    """(by, term, df, n) as `vocabulary` gives it, straight from the texts: a task hands on one row per run and stretch of documents, not one per document."""
    fields = docs.select(by).schema.fields
    schema = StructType([*fields, StructField("term", StringType()), StructField("df", LongType())])
    parts = spread(docs.where(F.col(by).isNotNull()), key).select(by, runs.items.alias("_items")).mapInArrow(document_counter(runs), schema)
    found = parts.groupBy(by, "term").agg(F.sum("df").alias("df")).join(docs.groupBy(by).agg(F.count(F.lit(1)).alias("n")), by)
    return found.where(F.col("df") >= F.col("n") * min_df)


def scaled_vectors(docs: DataFrame, runs: Runs, terms: DataFrame, by: str, key: str, known: Column) -> DataFrame:
    """docs without its texts, with i and v: places and TF-IDF weights (`tfidf`) of unit length, over each term's largest among the known rows.

    terms: by, term, idx, df, n. A group's texts meet its terms in shards of about SHARD_TEXTS texts, so a large group is many
    shards. A text without terms gets null, and so does one without a key.
    """
    names = [c for c in docs.columns if c != "text"]
    shards = docs.groupBy(by).agg(F.ceil(F.count("*") / SHARD_TEXTS).cast("int").alias("_shards"))
    each = F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)).alias("_shard")
    idf = (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")
    placed = docs.join(F.broadcast(shards), by).withColumn("_shard", F.pmod(F.xxhash64(key), F.col("_shards")).cast("int"))
    texts = placed.select(*names, "_shard", F.when(F.col(key).isNotNull(), runs.items).alias("_items"))
    settings = Runs(None, runs.low, runs.high, runs.glue)
    schema = StructType([*docs.select(*names).schema.fields, StructField("_shard", IntegerType()), StructField("i", ArrayType(IntegerType())), StructField("v", ArrayType(DoubleType()))])

    def listed(table: pa.Table, document: np.ndarray, i: pa.Array, v: pa.Array) -> pa.Table:
        sizes = np.bincount(document, minlength=table.num_rows)
        starts, empty = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(sizes == 0)
        for name, values in (("i", i), ("v", v)):
            table = table.append_column(name, pa.ListArray.from_arrays(starts, values, mask=empty))
        return table

    def weigh(texts: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("idx")
        document, at, tf = known_counts(texts["_items"].combine_chunks(), settings, words["term"].combine_chunks())
        weight = (1 + np.log(tf)) * words["idf"].to_numpy()[at]
        own = pc.fill_null(texts[key].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        of, groups = own[document], int(own.max(initial=0)) + 1
        weight /= np.sqrt(np.bincount(of, weight ** 2, groups))[of]
        place = of * max(words.num_rows, 1) + at
        order = np.lexsort((weight, place)) if len(np.unique(own)) < len(own) else np.argsort(place, kind="stable")
        held = np.bincount(of, minlength=groups)
        sizes, starts = held[own], (np.cumsum(held) - held)[own]
        order = order[np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]
        return listed(texts.select([*names, "_shard"]), np.repeat(np.arange(len(own)), sizes), pa.array(words["idx"].to_numpy()[at[order]].astype(np.int32)), pa.array(weight[order]))

    def scale(rows: pa.Table, tops: pa.Table) -> pa.Table:
        i, v = rows["i"].combine_chunks(), rows["v"].combine_chunks()
        sizes = i.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        document, place = np.repeat(np.arange(len(sizes)), sizes), i.flatten().to_numpy()
        top = np.zeros(max(place.max(initial=-1), tops["i"].to_numpy().max(initial=-1)) + 1)
        top[tops["i"].to_numpy()] = tops["top"].to_numpy()
        return listed(rows.select([*names, "_shard"]), document, pa.array(place), pa.array(v.flatten().to_numpy() / top[place]))

    def met(left: DataFrame, right: DataFrame, work) -> DataFrame:
        right = right.join(F.broadcast(shards), by).select(F.col(by).alias("_group"), *right.columns[1:], each)
        return left.groupBy(by, "_shard").cogroup(right.groupBy("_group", "_shard")).applyInArrow(work, schema)

    weighed = cut_lineage(met(texts, terms.select(by, "term", F.col("idx").cast("int").alias("idx"), idf), weigh))
    cells = weighed.where(known).select(by, F.explode(F.arrays_zip("i", "v")).alias("c")).select(by, "c.i", "c.v")
    tops = cells.groupBy(by, "i").agg(F.max("v").alias("top"))
    return met(weighed, tops, scale).drop("_shard")


def tfidf(counts: DataFrame, terms: DataFrame, keys: Sequence[str], by: Sequence[str] = (), sublinear: bool = True) -> DataFrame:
    """(keys..., term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), unit length per document.

    `keys` names the document and includes the columns in `by`. The vocabulary is joined without a
    hint: Spark broadcasts it when its measured size allows and else splits skewed terms.
    """
    tf = F.col("tf").cast("double")
    raw = (1 + F.ln(tf) if sublinear else tf) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    weighted = counts.join(terms, [*by, "term"]).select(*keys, "term", raw.alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*keys)))
    return weighted.select(*keys, "term", (F.col("_w") / norm).alias("weight"))


def text_weights(docs: DataFrame, runs: Runs, keys: Sequence[str], min_df: float = 0.0, max_df: float = 1.0) -> DataFrame:
    """(keys..., term, weight) as `tfidf` gives it over the counts and the `vocabulary` of docs, straight from the texts.

    The texts are counted twice, for the vocabulary and for the weights; no row per document and term is written or shuffled, but those
    of texts that share their keys, which are of unit length together. A vocabulary of more than MOST_TERMS terms is joined to
    written counts.
    """
    names, vocabulary_of = list(keys), docs.withColumn("_all", F.lit(0))
    terms = kept(run_vocabulary(vocabulary_of, runs, "_all", names[0], min_df).where(F.col("df") <= F.col("n") * max_df).drop("_all"), "vocabulary")
    if terms.count() > MOST_TERMS:
        return tfidf(kept(term_counts(docs, names, runs)), terms, names)
    known = terms.select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")).orderBy("term").collect()
    alone, repeated = docs, kept(docs.groupBy(*names).count().where("count > 1").select(*[F.col(c).alias(f"_{c}") for c in names]), "repeated")
    again = None
    if repeated.limit(1).count():
        same = [docs[c].eqNullSafe(repeated[f"_{c}"]) for c in names]
        alone = docs.join(repeated, same, "left_anti")
        again = tfidf(kept(term_counts(docs.join(repeated, same, "left_semi"), names, runs)), terms, names)
    placed = spread(alone, *names).select(*names, runs.items.alias("_items"))
    schema = StructType([*placed.select(*names).schema.fields, StructField("term", StringType()), StructField("weight", DoubleType())])
    found = placed.mapInArrow(weigher(runs, [r["term"] for r in known], [r["idf"] for r in known]), schema)
    return found if again is None else found.unionByName(again)


def max_abs_terms(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., term, top): the largest absolute weight of each term."""
    return weights.groupBy(*by, "term").agg(F.max(F.abs("weight")).alias("top"))


def scale_by_top(weights: DataFrame, tops: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    scaled = weights.join(tops, [*by, "term"])
    return scaled.select(*weights.columns[:-1], (F.col("weight") / F.col("top")).alias("weight"))


def chi2_scores(weights: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(term, chi2) of non-negative weights: class sums against class share times total.

    Classes without the term add their expected value, which the total already contains, so only
    the non-zero sums are ever formed.
    """
    n = scalars(labels.agg(F.count(F.lit(1)).alias("n")))["n"]
    shares = labels.groupBy(label).agg((F.count(F.lit(1)) / F.first(n)).alias("_share"))
    observed = weights.join(labels.select(key, label), key).groupBy("term", label).agg(F.sum("weight").alias("_o"))
    per_term = observed.join(shares, label).groupBy("term").agg(
        F.sum("_o").alias("_t"), F.sum(F.col("_o") * F.col("_o") / F.col("_share")).alias("_s"))
    return per_term.select("term", (F.col("_s") / F.col("_t") - F.col("_t")).alias("chi2"))


def select_k_best(weights: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Keep the k terms with the highest score (ties by term)."""
    best = scores.orderBy(F.desc("chi2"), "term").limit(k).select("term")
    return weights.join(best, "term", "left_semi").select(*weights.columns)


def naive_bayes_fit(weights: DataFrame, labels: DataFrame, key: str, label: str, alpha: float = 0.01):
    """Multinomial naive Bayes as two frames: (label, term, gain) and (label, prior, rest).

    A document's score is prior + sum(weight) * rest + sum(weight * gain), where rest is the log
    probability of a term never seen in the class and gain what a seen term adds to it.
    """
    size = scalars(weights.agg(F.countDistinct("term").alias("v")))["v"]
    n = scalars(labels.agg(F.count(F.lit(1)).alias("n")))["n"]
    joined = weights.join(labels.select(key, F.col(label).alias("label")), key)
    # written once: the known terms, the gains and the totals all read them
    sums = kept(joined.groupBy("label", "term").agg(F.sum("weight").alias("_s")), "sums")
    gains = sums.select("label", "term", (F.ln(F.col("_s") + alpha) - F.ln(F.lit(alpha))).alias("gain"))
    totals = sums.groupBy("label").agg(F.sum("_s").alias("_t"))
    priors = labels.groupBy(F.col(label).alias("label")).agg(F.ln(F.count(F.lit(1)) / F.first(n)).alias("prior"))
    rest = F.ln(F.lit(alpha)) - F.ln(F.coalesce(F.col("_t"), F.lit(0.0)) + alpha * size)
    return gains, priors.join(totals, "label", "left").select("label", "prior", rest.alias("rest"))


def naive_bayes_predict(weights: DataFrame, model, key: str) -> DataFrame:
    """(key, predicted); terms unknown to the training set are ignored."""
    gains, classes = model
    # model frames: terms x classes, and one row per class collected into a small array
    known = gains.select("term").distinct()
    seen = weights.join(known, "term", "left_semi")
    totals = seen.groupBy(key).agg(F.sum("weight").alias("_w"))
    table = classes.agg(F.collect_list(F.struct("label", "prior", "rest")).alias("c"))
    per_class = totals.select(key, "_w", F.explode(table.scalar()).alias("_c")).select(key, "_w", "_c.*")
    extra = seen.join(gains, "term").groupBy(key, "label").agg(F.sum(F.col("weight") * F.col("gain")).alias("_g"))
    scored = per_class.join(extra, [key, "label"], "left").withColumn(
        "score", F.col("prior") + F.col("_w") * F.col("rest") + F.coalesce(F.col("_g"), F.lit(0.0)))
    return scored.groupBy(key).agg(F.min_by("label", F.struct(-F.col("score"), F.col("label"))).alias("predicted"))


def index_terms(terms: DataFrame) -> DataFrame:
    """(term, idx): vocabulary numbered in alphabetical order."""
    return ordered_index(terms.select("term"), ["term"], name="idx")


@F.udf(VectorUDT())
def sparse_vector(size, cells):
    return Vectors.sparse(size, [(c["idx"], c["weight"]) for c in cells])


def _vector_batches(size: int, name: str):
    """A function over batches that end with (i, v), the places and values of a row, and gives them as one sparse vector."""

    def turn(batches):
        for batch in batches:
            n, rest = batch.num_rows, batch.columns[:-2]
            vector = pa.StructArray.from_arrays(
                [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *batch.columns[-2:]], names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*rest, vector], names=[*batch.schema.names[:-2], name])

    return turn


def packed_vectors(rows: DataFrame, size: int, name: str = "features") -> DataFrame:
    """rows that end with (i, v), with one sparse vector in their place: the stored form of a vector, made for whole batches."""
    return rows.mapInArrow(_vector_batches(size, name), StructType([*rows.schema.fields[:-2], StructField(name, VectorUDT())]))


def vector_cells(weights: DataFrame, index: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """(key, cells): the terms of a document as (idx, weight) in order of idx; `by` when groups number their terms apart."""
    cell = F.struct(F.col("idx").cast("int").alias("idx"), "weight")
    return weights.join(index, [*by, "term"]).groupBy(key).agg(F.sort_array(F.collect_list(cell)).alias("cells"))


def to_vectors(weights: DataFrame, docs: DataFrame, key: str, index: DataFrame, name: str = "features") -> DataFrame:
    """docs with one sparse vector each; a document without known terms gets an empty one."""
    size = index.count()
    none = F.array().cast("array<struct<idx:int,weight:double>>")
    joined = docs.join(vector_cells(weights, index, key).withColumnRenamed("cells", "_cells"), key, "left").withColumn("_cells", F.coalesce("_cells", none))
    rows = joined.select(*joined.columns[:-1], F.col("_cells.idx").alias("_i"), F.col("_cells.weight").alias("_v"))
    return packed_vectors(rows, size, name)
