"""Counting inside the row and the a-priori rule against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from analystry.functions import text as T
from analystry.operators import features as X

TEXTS = [(1, "aa bb aa bb cc"), (2, "bb aa bb dd"), (3, ""), (4, None), (5, "ee"), (6, "aa bb aa bb cc"), (7, "aa " * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def grams(items, low, high, glue):
    return Counter(glue.join(items[i:i + n]) for n in range(low, high + 1) for i in range(len(items) - n + 1))


def found(counts):
    return {(r["doc_id"], r["term"]): r["tf"] for r in counts.collect()}


def expected(split, low, high, glue):
    return {(key, term): tf for key, text in TEXTS if text for term, tf in grams(split(text), low, high, glue).items()}


def test_counts_inside_the_row(docs):
    words = X.term_counts(docs, ["doc_id"], X.word_terms("text"))
    assert found(words) == expected(str.split, 1, 3, " ")
    assert dict(words.dtypes)["tf"] == "bigint"
    assert found(X.term_counts(docs, ["doc_id"], X.char_terms("text"))) == expected(list, 2, 5, "")


def test_no_documents(docs):
    none = docs.where("false")
    runs = X.frequent_runs(none, T.word_tokens(F.col("text")), 1, 3, " ", 1, 0.5)
    assert X.term_counts(none, ["doc_id"], runs).count() == 0


@pytest.mark.parametrize("marker, share", [(1, 0.25), (1, 0.4), (2, 0.25), (1, 0.0), (3, 0.4)])
def test_frequent_runs_keep_the_vocabulary(docs, marker, share):
    every = expected(str.split, 1, 3, " ")
    df = Counter(term for _, term in every)
    runs = X.frequent_runs(docs, T.word_tokens(F.col("text")), 1, 3, " ", marker, share)
    counts = X.kept(X.term_counts(docs, ["doc_id"], runs))
    terms = {r["term"]: r["df"] for r in X.vocabulary(counts, docs, min_df=share).collect()}
    assert terms == {term: n for term, n in df.items() if n >= share * len(TEXTS)}
    assert all(every[cell] == tf for cell, tf in found(counts).items())


def test_characters_with_a_long_marker(docs):
    every = expected(list, 2, 5, "")
    df = Counter(term for _, term in every)
    runs = X.frequent_runs(docs, T.characters(F.col("text")), 2, 5, "", 4, 0.4)
    terms = {r["term"] for r in X.vocabulary(X.term_counts(docs, ["doc_id"], runs), docs, min_df=0.4).collect()}
    assert terms == {term for term, n in df.items() if n >= 0.4 * len(TEXTS)}


def test_too_many_markers_form_every_run(docs, monkeypatch):
    monkeypatch.setattr(X, "MOST_MARKERS", 1)
    runs = X.frequent_runs(docs, T.word_tokens(F.col("text")), 1, 3, " ", 1, 0.1)
    assert found(X.term_counts(docs, ["doc_id"], runs)) == expected(str.split, 1, 3, " ")


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_weights_straight_from_the_texts_equal_those_of_written_counts(spark, monkeypatch, most):
    monkeypatch.setattr(X, "MOST_TERMS", most)
    # keys that repeat, or are null, share one unit length
    docs = spark.createDataFrame([*TEXTS, (1, "cc aa"), (None, "aa bb"), (None, "bb cc bb")], "doc_id long, text string")
    runs = X.frequent_runs(docs, T.word_tokens(F.col("text")), 1, 3, " ", 1, 0.25)
    counts = X.term_counts(docs, ["doc_id"], runs)
    want = X.tfidf(counts, X.vocabulary(counts, docs, min_df=0.25, max_df=0.6), ["doc_id"])
    cells = lambda rows: sorted((str(r["doc_id"]), r["term"], round(r["weight"], 9)) for r in rows.collect())
    assert cells(X.text_weights(docs, runs, ["doc_id"], 0.25, 0.6)) == cells(want) != []


def test_tfidf_of_texts_writes_no_counts(spark, tmp_path, monkeypatch):
    from analystry.registry import QUERIES

    spark.createDataFrame([(i, "en", f"text {i % 3} of some words") for i in range(20)], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(X, "term_counts", None)
    found = QUERIES["tfidf_char_ngrams"](spark, str(tmp_path))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 20


def test_hashed_texts_are_not_made_dense(spark, tmp_path):
    from analystry.registry.book import QUERIES
    spark.createDataFrame([(1, "x", "pear plum pear"), (2, "x", ""), (3, "x", None)], "doc_id long, lang string, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    found = QUERIES["hashed_counts"](spark, str(tmp_path))
    assert "vector_to_array" not in found._jdf.queryExecution().logical().toString()
    rows = {r["doc_id"]: (r["slots"], r["top"]) for r in found.where("doc_id < 3").collect()}
    assert rows == {1: (2, round(2 / 5 ** 0.5, 6)), 2: (0, 0.0)}


def test_word_vectors_train_on_all_cores(spark):
    from analystry.plans.words import word_vectors
    model = word_vectors(spark.createDataFrame([(["a", "b"] * 5,)] * 40, "words array<string>"), size=4)
    assert model.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r["word"] for r in model.getVectors().collect()) == ["a", "b"]


def test_spread_bounds_the_rows_of_a_task(spark):
    from analystry.session import spread
    assert spread(spark.range(1000, numPartitions=4), "id", rows=100).rdd.getNumPartitions() == 10


def test_runs_are_counted_in_batches(spark, monkeypatch):
    """Counting is done on Arrow batches, also where a slice ends inside a batch, codes are renumbered or items repeat the glue."""
    import pyarrow as pa

    from analystry.operators import run_counts as R
    docs = spark.createDataFrame([(1, "añ𝒳a añ"), (None, "xy"), (1, "añ𝒳a añ"), (2, ""), (3, None)], "doc_id long, text string")
    counted = X.term_counts(docs, ["doc_id"], X.char_terms("text"))
    assert "MapInArrow" in counted._jdf.queryExecution().executedPlan().toString()
    rows = Counter((r["doc_id"], r["term"], r["tf"]) for r in counted.collect())
    every = Counter({(1, term, tf): 2 for term, tf in grams("añ𝒳a añ", 2, 5, "").items()})
    assert rows == every + Counter({(None, "xy", 1): 1})

    words = [["a", "a b", "b", "a"], [], ["a", "b", "a b", "a", "b"], ["c"] * 9]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3]), pa.array(words)], names=["key", "items"])
    wanted = sum((Counter({(key, term): tf for term, tf in grams(items, 1, 3, " ").items()}) for key, items in enumerate(words)), Counter())
    for part, codes in ((R.SLICE, R.MOST_CODES), (4, 8)):
        monkeypatch.setattr(R, "SLICE", part)
        monkeypatch.setattr(R, "MOST_CODES", codes)
        found = [cell for b in R.counter(R.Runs(None, 1, 3, " "))([batch]) for cell in zip(*b.to_pydict().values(), strict=True)]
        assert sorted(found) == sorted((*cell, tf) for cell, tf in wanted.items())


def test_vectors_are_made_in_batches(spark):
    weights = spark.createDataFrame([(1, "b", 0.25), (1, "a", 0.5), (2, "b", 1.0)], "doc_id long, term string, weight double")
    index = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "term string, idx long")
    docs = spark.createDataFrame([(1, "x"), (2, None), (2, "z"), (3, "y"), (None, "y")], "doc_id long, lang string")
    rows = X.to_vectors(weights, docs, "doc_id", index)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BatchEvalPython" not in plan
    found = {(r["doc_id"], r["lang"]): (r["features"].size, r["features"].indices.tolist(), r["features"].values.tolist()) for r in rows.collect()}
    assert found == {(1, "x"): (3, [0, 2], [0.25, 0.5]), (2, None): (3, [0], [1.0]), (2, "z"): (3, [0], [1.0]), (3, "y"): (3, [], []), (None, "y"): (3, [], [])}
    assert X.to_vectors(weights, docs.where("false"), "doc_id", index).count() == 0


def test_class_sums_are_made_once(spark):
    weights = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "b", 1.0), (2, "b", 1.0)], "doc_id long, term string, weight double")
    labels = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, lang string")
    gains, classes = X.naive_bayes_fit(weights, labels, "doc_id", "lang")
    assert "Join" not in gains._jdf.queryExecution().optimizedPlan().toString()
    asked = spark.createDataFrame([(7, "a", 1.0), (8, "b", 1.0), (9, "new", 1.0)], "doc_id long, term string, weight double")
    assert {r["doc_id"]: r["predicted"] for r in X.naive_bayes_predict(asked, (gains, classes), "doc_id").collect()} == {7: "x", 8: "y"}
