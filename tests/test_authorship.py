"""From a collection folder to answer files, and stages that are saved and read again."""

import json
import math
import os
from collections import Counter

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from analystry.operators import features as X
from analystry.operators.run_counts import Runs, document_counter
from analystry.plans import authorship as A

STYLES = {"c1": "the cat sat on the mat and the cat ran ", "c2": "of wine and bread she sang, of wine! ", "c3": "12 numbers 34 go 56 up 78 "}


def collection(path):
    (path / "collection-info.json").write_text(json.dumps(
        [{"problem-name": p, "language": lang, "encoding": "UTF-8"} for p, lang in (("p1", "en"), ("p2", "fr"), ("p3", "en"))]))
    for p in ("p1", "p2", "p3"):
        os.makedirs(path / p / "unknown")
        authors = {k: v for k, v in STYLES.items() if p != "p3" or k == "c1"}  # p3 knows one author
        (path / p / "problem-info.json").write_text(json.dumps(
            {"unknown-folder": "unknown", "candidate-authors": [{"author-name": a} for a in authors]}))
        for author, line in authors.items():
            os.makedirs(path / p / author)
            for k in range(4):  # the same names in every folder
                (path / p / author / f"known{k}.txt").write_text(line * (k + 2), encoding="utf-8")
            (path / p / "unknown" / f"of-{author}.txt").write_text(line * 7, encoding="utf-8")


@pytest.mark.parametrize("version", [1, 2])
def test_folders_to_answers(spark, tmp_path, version):
    collection(tmp_path)
    target = tmp_path / f"answers{version}"
    A.run(spark, str(tmp_path), str(target), version, iterations=20, folds=2, strengths=(0.1, 1.0))
    for p, count in (("p1", 3), ("p2", 3), ("p3", 1)):
        found = json.loads((target / f"answers-{p}.json").read_text())
        assert len(found) == count and all(r["unknown-text"] == f"of-{r['predicted-author']}.txt" for r in found)


def test_texts_without_terms_problem_or_author(spark):
    rows = [(k, "p", "fr", "candidate", a, f"{a}{k}", t) for k, (a, t) in enumerate([("a", "one one"), ("a", "one two"), ("b", "six six"), ("b", "six ten")])]
    rows += [(10, "p", "fr", "unknown", "unknown", "u1", None), (11, "p", "fr", "unknown", "unknown", "u2", ""), (12, "p", "fr", "unknown", "unknown", "u3", "six six"),
             (13, "p", "fr", "candidate", None, "n", "x"), (14, None, "fr", "unknown", "unknown", "u4", "one"),
             (15, "silent", "fr", "candidate", "z", "z", ""), (16, "silent", "fr", "unknown", "unknown", "u5", "one"), (17, "nobody", "fr", "unknown", "unknown", "u6", "one")]
    schema = "doc_id long, problem string, language string, role string, label string, filename string, text string"
    found = {(r["problem"], r["unknown-text"]): r["predicted-author"] for r in A.attribute(spark.createDataFrame(rows, schema), iterations=10).collect()}
    assert set(found) == {("p", "u1"), ("p", "u2"), ("p", "u3"), ("silent", "u5")}
    assert found["p", "u3"] == "b" and found["silent", "u5"] == "z"
    assert A.attribute(spark.createDataFrame([], schema)).count() == 0


def test_stages_keep_their_settings(spark, tmp_path):
    docs = spark.createDataFrame([(k, t * (k + 1), a) for k, (a, t) in enumerate(list(STYLES.items()) * 3)] + [(99, None, "c1")], "doc_id int, text string, label string")
    stage = A.WordObfuscator(mask=True, outputCol="m")
    stage.save(str(tmp_path / "stage"))
    for other in (stage.copy(), A.WordObfuscator.load(str(tmp_path / "stage"))):
        assert other.getOrDefault("mask") and other.getOutputCol() == "m"
        assert other.transform(docs.limit(1)).first()["m"].startswith("xxx xxx")
    A.text_pipeline("label").save(str(tmp_path / "chain"))
    model = Pipeline.load(str(tmp_path / "chain")).fit(docs)
    model.save(str(tmp_path / "model"))
    found = PipelineModel.load(str(tmp_path / "model")).transform(docs.where("text IS NOT NULL"))
    assert found.where(F.col("prediction") == F.col("_y")).count() == 9


def test_features_of_shards_against_counting(spark, monkeypatch):
    monkeypatch.setattr(X, "SHARD_TEXTS", 3)
    texts = ["banana bandana", "a banana", "", None, "cab a cab", "bananas", "x", "nab a ban"]
    rows = [(p * 100 + k, f"p{p}", "unknown" if k % 4 == 3 else "candidate", f"a{k % 2}", t) for p in range(2) for k, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, problem string, role string, label string, text string")
    found = {r["doc_id"]: dict(zip(r["i"] or [], r["v"] or [])) for r in A.text_features(docs, X.char_terms("text", 1, 2), min_df=0.2).collect()}
    assert len(found) == len(rows)
    for p in range(2):
        mine = {k: Counter(t[i:i + n] for n in (1, 2) for i in range(len(t) - n + 1)) for k, q, _, _, t in rows if q == f"p{p}" for t in [t or ""]}
        known = [k for k, q, role, _, _ in rows if q == f"p{p}" and role == "candidate"]
        df = Counter(t for k in known for t in mine[k])
        terms = sorted(t for t, n in df.items() if n >= 0.2 * len(known))
        raw = {k: {t: (1 + math.log(c[t])) * (math.log((1 + len(known)) / (1 + df[t])) + 1) for t in terms if t in c} for k, c in mine.items()}
        unit = {k: {t: w / math.sqrt(sum(x * x for x in r.values())) for t, w in r.items()} for k, r in raw.items()}
        top = {t: max(unit[k].get(t, 0) for k in known) for t in terms}
        for k, r in unit.items():
            assert found[k] == pytest.approx({terms.index(t): w / top[t] for t, w in r.items()})


def test_rows_with_one_key_are_one_document(spark):
    rows = [(k, "p", "candidate", "a", t) for k, t in [(1, "ab"), (1, "ab"), (2, "ab"), (None, "ab"), (3, "b")]]
    docs = spark.createDataFrame(rows, "doc_id long, problem string, role string, label string, text string")
    found = sorted((r["doc_id"] or 0, r["i"], [round(v, 9) for v in r["v"] or []]) for r in A.text_features(docs, X.char_terms("text", 1, 1)).collect())
    half = round(math.sqrt(0.5), 9)
    assert found[0] == (0, None, []) and found[1] == found[2] and found[1][1] == [0, 0, 1, 1] and found[3][1] == [0, 1] and found[4][1:] == ([1], [1.0])
    assert found[1][2][:2] == [half, half] and found[3][2][0] == 1.0


def test_vocabulary_hands_on_runs_not_documents(spark):
    """Three hundred texts of one batch give each run once, not once per text, and texts without a place of their own are not lost."""
    docs = spark.range(300).select(F.lit("p").alias("problem"), F.lit("abcab").alias("text")).coalesce(1)
    counted = docs.mapInArrow(document_counter(Runs(None, 1, 2)), "problem string, term string, df long")
    assert sorted(map(tuple, counted.collect())) == [("p", t, 300) for t in ("a", "ab", "b", "bc", "c", "ca")]
    words = spark.createDataFrame([("p", ["a b", "c"]), ("p", ["a", "b c"]), ("q", None)], "problem string, words array<string>")
    counted = words.coalesce(1).mapInArrow(document_counter(Runs(None, 1, 2, " ")), "problem string, term string, df long")
    assert sorted(map(tuple, counted.collect())) == [("p", t, n) for t, n in (("a", 1), ("a b", 1), ("a b c", 2), ("b c", 1), ("c", 1))]


def test_term_runs_and_vocabulary_equal_the_column_form(spark):
    from pyspark.ml.feature import CountVectorizer

    from analystry.functions import text as T

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["aa bb aa cc", "bb aa", "", None, "dd", "aa bb cc dd ee"])], "k int, text string")
    text = F.coalesce("text", F.lit(""))
    for words, low, high in ((True, 1, 2), (True, 2, 3), (False, 2, 5)):
        found = A.TermRuns(words=words, low=low, high=high).transform(rows)
        plain = T.word_ngrams(T.word_tokens(text), low, high) if words else T.all_char_ngrams(text, low, high)
        assert all(r["terms"] == r["p"] for r in found.withColumn("p", plain).collect())
        for least in (0.3, 2.0):
            settings = dict(inputCol="terms", outputCol="v", minDF=least)
            assert sorted(A.TermVectorizer(**settings).fit(found).vocabulary) == sorted(CountVectorizer(**settings).fit(found).vocabulary)
