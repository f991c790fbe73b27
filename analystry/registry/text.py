"""TF-IDF, vocabulary, chi-squared and naive Bayes over the documents table."""

from pyspark.sql import functions as F

from analystry.functions import text as T
from analystry.functions.stopwords import ENGLISH
from analystry.operators import features as X
from analystry.operators.run_counts import Runs
from analystry.registry.book import query, rounded
from analystry.session import table

W = r"[\p{L}\p{N}_]"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def weighted(df, terms, keys=("doc_id",), min_df=0.05, max_df=1.0):
    if isinstance(terms, Runs):
        return X.text_weights(df, terms, keys, min_df, max_df)
    counts = X.kept(X.term_counts(df, list(keys), terms))
    # written, its size is known: a small vocabulary goes to the counts, which are then not shuffled by term
    terms = X.kept(X.vocabulary(counts, df, min_df=min_df, max_df=max_df), "vocabulary")
    return X.tfidf(counts, terms, list(keys))


def char_terms(docs, text=None, min_df=0.05):
    return X.frequent_runs(docs, F.col("text") if text is None else text, 2, 5, "", 3, min_df)


def word_terms(docs, lowercase=False, min_df=0.05):
    words = T.word_tokens(F.lower("text") if lowercase else F.col("text"))
    return X.frequent_runs(docs, words, 1, 3, " ", 1, min_df)


CHARS = """c AS (SELECT doc_id, unnest(string_split(text,'')) AS a, generate_subscripts(string_split(text,''),1) AS i FROM documents),
l AS (SELECT doc_id, a, lead(a,1) OVER w AS b, lead(a,2) OVER w AS c, lead(a,3) OVER w AS d, lead(a,4) OVER w AS e FROM c
      WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, a||b AS term FROM l UNION ALL SELECT doc_id, a||b||c FROM l UNION ALL SELECT doc_id, a||b||c||d FROM l
      UNION ALL SELECT doc_id, a||b||c||d||e FROM l),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g WHERE term IS NOT NULL GROUP BY 1,2)"""

WORDS = f"""t AS (SELECT doc_id, unnest(regexp_extract_all(TEXT,'{W}{{2,}}')) AS a,
      generate_subscripts(regexp_extract_all(TEXT,'{W}{{2,}}'),1) AS i FROM documents)"""

RUNS = """l AS (SELECT doc_id, a, lead(a,1) OVER w AS b, lead(a,2) OVER w AS c FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, a AS term FROM l UNION ALL SELECT doc_id, a||' '||b FROM l UNION ALL SELECT doc_id, a||' '||b||' '||c FROM l),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g WHERE term IS NOT NULL GROUP BY 1,2)"""

WEIGHTS = """n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
v AS (SELECT term, df, n FROM df, n WHERE df >= n*{low}::DOUBLE AND df <= n*{high}::DOUBLE),
r AS (SELECT doc_id, term, (1+ln(tf::DOUBLE))*(ln((1+n)::DOUBLE/(1+df))+1) AS w FROM tf JOIN v USING (term)),
w AS (SELECT doc_id, term, w/sqrt(sum(w*w) OVER (PARTITION BY doc_id)) AS weight FROM r)"""


@query("tfidf_char_ngrams", f"""WITH {CHARS}, {WEIGHTS.format(low=0.05, high=1.0)}
SELECT doc_id, count(*) AS terms, round(sum(weight),6) AS total, round(max(weight),6) AS top FROM w GROUP BY doc_id""")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir)
    w = weighted(docs, char_terms(docs))
    return rounded(w.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("weight").alias("total"), F.max("weight").alias("top")))


@query("tfidf_masked_char_ngrams", f"""WITH {CHARS.replace("(text,", f"(regexp_replace(text,'{W}','x','g'),")}, {WEIGHTS.format(low=0.05, high=1.0)}
SELECT doc_id, term, round(weight,6) AS weight FROM w""")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return rounded(weighted(docs, char_terms(docs, T.mask_word_characters(F.col("text")))))


@query("tfidf_word_ngrams", f"""WITH {WORDS.replace('TEXT', 'text')}, {RUNS}, {WEIGHTS.format(low=0.05, high=1.0)}
SELECT doc_id, term, round(weight,6) AS weight FROM w""")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return rounded(weighted(docs, word_terms(docs)))


@query("tfidf_word_ngrams_lowercase", f"""WITH {WORDS.replace('TEXT', 'lower(text)')}, {RUNS}, {WEIGHTS.format(low=0.05, high=1.0)}
SELECT doc_id, count(*) AS terms, round(sum(weight),6) AS total FROM w GROUP BY doc_id""")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir)
    w = weighted(docs, word_terms(docs, lowercase=True))
    return rounded(w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("weight").alias("total")))


STOP = ",".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
PLAIN = f"""{WORDS.replace('TEXT', 'lower(text)')},
tf AS (SELECT doc_id, a AS term, count(*) AS tf FROM t WHERE a NOT IN ({STOP}) GROUP BY 1,2)"""


def plain(spark, sf_dir):
    return weighted(documents(spark, sf_dir), X.plain_words("text", ENGLISH), min_df=0.0, max_df=0.5)


@query("tfidf_stop_words", f"""WITH {PLAIN}, {WEIGHTS.format(low=0.0, high=0.5)}
SELECT doc_id, count(*) AS terms, round(sum(weight),6) AS total, round(max(weight),6) AS top FROM w GROUP BY doc_id""")
def _(spark, sf_dir):
    return rounded(plain(spark, sf_dir).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("weight").alias("total"), F.max("weight").alias("top")))


@query("document_frequency", f"""WITH {PLAIN} SELECT term, count(*) AS df FROM tf GROUP BY term""")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return X.vocabulary(X.term_counts(docs, ["doc_id"], X.plain_words("text", ENGLISH)), docs).select("term", "df")


@query("term_index", f"""WITH {PLAIN}, {WEIGHTS.format(low=0.05, high=0.5)} SELECT term, row_number() OVER (ORDER BY encode(term))-1 AS idx FROM v""")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir)
    counts = X.term_counts(docs, ["doc_id"], X.plain_words("text", ENGLISH))
    return X.index_terms(X.vocabulary(counts, docs, min_df=0.05, max_df=0.5))


@query("hashed_counts")
def _(spark, sf_dir):
    from pyspark.ml.feature import HashingTF, Normalizer
    docs = documents(spark, sf_dir).select("doc_id", X.plain_words("text", ENGLISH).alias("words"))
    hashed = HashingTF(numFeatures=2 ** 16, inputCol="words", outputCol="h").transform(docs)
    unit = Normalizer(p=2.0, inputCol="h", outputCol="u").transform(hashed)
    # the stored entries only: as an array a text would be 2^16 numbers, nearly all of them zero
    values = F.unwrap_udt("u")["values"]
    return rounded(unit.select("doc_id", F.size(F.filter(values, lambda x: x > 0)).alias("slots"),
                               F.coalesce(F.array_max(values), F.lit(0.0)).alias("top")))


@query("chi2_terms", f"""WITH {PLAIN}, {WEIGHTS.format(low=0.0, high=0.5)},
y AS (SELECT doc_id, lang FROM documents), p AS (SELECT lang, count(*)::DOUBLE/(SELECT n FROM n) AS share FROM y GROUP BY lang),
f AS (SELECT term, sum(weight) AS t FROM w GROUP BY term), o AS (SELECT term, lang, sum(weight) AS o FROM w JOIN y USING (doc_id) GROUP BY 1,2),
e AS (SELECT f.term, p.lang, share*t AS e FROM f, p)
SELECT term, round(sum(power(coalesce(o,0)-e,2)/e),6) AS chi2 FROM e LEFT JOIN o USING (term, lang) GROUP BY term""")
def _(spark, sf_dir):
    labels = documents(spark, sf_dir).select("doc_id", "lang")
    return rounded(X.chi2_scores(plain(spark, sf_dir), labels, "doc_id", "lang"))


@query("chi2_best_terms", f"""WITH {PLAIN}, {WEIGHTS.format(low=0.0, high=0.5)},
y AS (SELECT doc_id, lang FROM documents), p AS (SELECT lang, count(*)::DOUBLE/(SELECT n FROM n) AS share FROM y GROUP BY lang),
o AS (SELECT term, lang, sum(weight) AS o FROM w JOIN y USING (doc_id) GROUP BY 1,2),
c AS (SELECT term, sum(o*o/share)/sum(o) - sum(o) AS chi2 FROM o JOIN p USING (lang) GROUP BY term ORDER BY chi2 DESC, encode(term) LIMIT 200)
SELECT term, count(*) AS df FROM w JOIN c USING (term) GROUP BY term""")
def _(spark, sf_dir):
    w, labels = X.kept(plain(spark, sf_dir), "weights"), documents(spark, sf_dir).select("doc_id", "lang")
    kept = X.select_k_best(w, X.chi2_scores(w, labels, "doc_id", "lang"), 200)
    return kept.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("max_abs_term_weights", f"""WITH {PLAIN}, {WEIGHTS.format(low=0.05, high=0.5)}
SELECT doc_id, term, round(weight/max(abs(weight)) OVER (PARTITION BY term),6) AS weight FROM w""")
def _(spark, sf_dir):
    w = X.kept(weighted(documents(spark, sf_dir), X.plain_words("text", ENGLISH), min_df=0.05, max_df=0.5), "weights")
    return rounded(X.scale_by_top(w, X.max_abs_terms(w)))


@query("naive_bayes", f"""WITH {PLAIN}, {WEIGHTS.format(low=0.0, high=0.5)},
y AS (SELECT doc_id, lang FROM documents WHERE doc_id%5<>0), k AS (SELECT count(*) AS docs FROM y),
s AS (SELECT lang, term, sum(weight) AS s FROM w JOIN y USING (doc_id) GROUP BY 1,2),
vs AS (SELECT DISTINCT term FROM s), z AS (SELECT count(*) AS v FROM vs), tt AS (SELECT lang, sum(s) AS t FROM s GROUP BY lang),
pr AS (SELECT lang, ln(count(*)::DOUBLE/(SELECT docs FROM k)) AS prior FROM y GROUP BY lang),
q AS (SELECT doc_id, term, weight FROM w WHERE doc_id%5=0 AND term IN (SELECT term FROM vs)),
b AS (SELECT doc_id, lang, prior + sum(weight*ln((coalesce(s,0)+0.01::DOUBLE)/(t+0.01::DOUBLE*(SELECT v FROM z)))) AS score
      FROM (SELECT * FROM q, pr JOIN tt USING (lang)) x LEFT JOIN s USING (lang, term) GROUP BY doc_id, lang, prior)
SELECT doc_id, lang AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS i FROM b) WHERE i=1""")
def _(spark, sf_dir):
    w, labels = X.kept(plain(spark, sf_dir), "weights"), documents(spark, sf_dir).select("doc_id", "lang")
    held_out = F.col("doc_id") % 5 == 0
    known = labels.where(~held_out)
    model = X.naive_bayes_fit(w.where(~held_out), known, "doc_id", "lang")
    return X.naive_bayes_predict(w.where(held_out), model, "doc_id")
