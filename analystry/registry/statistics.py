"""Correlation, histograms, density, covariance and classification quality."""

from pyspark.sql import functions as F

from analystry.operators import statistics as S
from analystry.registry.book import query, rounded
from analystry.session import table


def vectors(spark, sf_dir, dims=5):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(dims)])


@query("corr_with_target", """SELECT pos::INTEGER AS pos, round(corr(x,y),6) AS r, round(abs(corr(x,y)),6) AS abs_r FROM
(SELECT i-1 AS pos, embedding[i]::DOUBLE AS x, (label=1)::INTEGER::DOUBLE AS y FROM embeddings, generate_series(1,64) t(i)) GROUP BY 1
ORDER BY 3 DESC, 1 LIMIT 10""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") == 1).cast("int"))
    return rounded(S.array_corr_with_target(df, "embedding", "y").orderBy(F.desc("abs_r"), "pos").limit(10))


@query("feature_relevance", """SELECT * FROM (
SELECT 'l_quantity' AS feature, round(corr(l_quantity,l_tax),6) AS r, round(abs(corr(l_quantity,l_tax)),6) AS abs_r FROM lineitem UNION ALL
SELECT 'l_discount', round(corr(l_discount,l_tax),6), round(abs(corr(l_discount,l_tax)),6) FROM lineitem UNION ALL
SELECT 'l_extendedprice', round(corr(l_extendedprice,l_tax),6), round(abs(corr(l_extendedprice,l_tax)),6) FROM lineitem)""")
def _(spark, sf_dir):
    return rounded(S.corr_with_target(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"], "l_tax"))


@query("most_correlated", """WITH c AS (SELECT 'l_extendedprice' AS feature, abs(corr(l_extendedprice,l_quantity)) AS a FROM lineitem
UNION ALL SELECT 'l_tax', abs(corr(l_tax,l_quantity)) FROM lineitem UNION ALL SELECT 'l_discount', abs(corr(l_discount,l_quantity)) FROM lineitem)
SELECT arg_max(feature,a) AS feature, round(max(a),6) AS abs_r FROM c""")
def _(spark, sf_dir):
    return rounded(S.most_correlated(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_tax", "l_discount"], "l_quantity"))


CORR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round({'1.0::DOUBLE' if a == b else f'corr({a},{b})'},6) AS r, "
    f"round({'1.0::DOUBLE' if a == b else f'abs(corr({a},{b}))'},6) AS abs_r" + ("" if a == b else " FROM lineitem")
    for a in CORR_COLUMNS for b in CORR_COLUMNS))
def _(spark, sf_dir):
    return rounded(S.corr_matrix(table(spark, sf_dir, "lineitem"), CORR_COLUMNS))


HIST = """WITH r AS (SELECT min(value) a, max(value) b FROM events),
h AS (SELECT {key} least(floor((value-a)/((b-a)/{bins}))::INTEGER,{bins}-1) AS bin, a, b FROM events, r)
SELECT {key} bin, round(a+bin*((b-a)/{bins}),6) AS lo, round(a+(bin+1)*((b-a)/{bins}),6) AS hi, count(*) AS n FROM h GROUP BY ALL"""


@query("histogram_100", HIST.format(key="", bins=100))
def _(spark, sf_dir):
    return rounded(S.histogram(table(spark, sf_dir, "events"), "value", 100))


@query("histogram_per_class", HIST.format(key="event_type,", bins=30))
def _(spark, sf_dir):
    return rounded(S.histogram(table(spark, sf_dir, "events"), "value", 30, ["event_type"]))


@query("histogram_own_range", """WITH r AS (SELECT event_type, min(value) a, max(value) b FROM events GROUP BY 1),
h AS (SELECT event_type, least(floor((value-a)/((b-a)/10))::INTEGER,9) AS bin, a, b FROM events JOIN r USING (event_type))
SELECT event_type, bin, round(a+bin*((b-a)/10),6) AS lo, round(a+(bin+1)*((b-a)/10),6) AS hi, count(*) AS n FROM h GROUP BY ALL""")
def _(spark, sf_dir):
    return rounded(S.histogram(table(spark, sf_dir, "events"), "value", 10, ["event_type"], own_range=True))


@query("kernel_density", """WITH s AS (SELECT min(value) lo, max(value) hi, stddev_samp(value)*power(count(*),-0.2::DOUBLE) h FROM events),
g AS (SELECT i, h, lo-3*h + i*((hi-lo+6*h)/39) AS g FROM s, generate_series(0,39) t(i))
SELECT i::INTEGER AS i, round(g,6) AS g, round(avg(exp(-0.5*((g-value)/h)*((g-value)/h))/(h*sqrt(2*pi()))),6) AS density
FROM g, events GROUP BY i, g""")
def _(spark, sf_dir):
    return rounded(S.kde(table(spark, sf_dir, "events"), "value", 40))


@query("kernel_density_2d", """WITH s AS (SELECT min(c_acctbal) xl, max(c_acctbal) xh, min(c_nationkey) yl, max(c_nationkey) yh,
stddev_samp(c_acctbal)*power(count(*),-1.0::DOUBLE/6) hx, stddev_samp(c_nationkey)*power(count(*),-1.0::DOUBLE/6) hy FROM customer),
g AS (SELECT i, j, hx, hy, xl+i*((xh-xl)/9) AS gx, yl+j*((yh-yl)/9.0::DOUBLE) AS gy FROM s, generate_series(0,9) t(i), generate_series(0,9) u(j))
SELECT i::INTEGER AS i, j::INTEGER AS j, round(gx,6) AS gx, round(gy,6) AS gy, round(1e6*avg(exp(-0.5*(((gx-c_acctbal)/hx)*((gx-c_acctbal)/hx)
+((gy-c_nationkey)/hy)*((gy-c_nationkey)/hy)))/(2*pi()*hx*hy)),6) AS density FROM g, customer GROUP BY 1,2,3,4""")
def _(spark, sf_dir):
    d = S.kde2d(table(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey", 10)
    return rounded(d.withColumn("density", F.col("density") * 1e6))


@query("padded_limits", """SELECT 'value' AS feature, round(min(value)-0.05*(max(value)-min(value)),6) AS low,
round(max(value)+0.05*(max(value)-min(value)),6) AS high FROM events""")
def _(spark, sf_dir):
    return rounded(S.limits(table(spark, sf_dir, "events"), ["value"]))


@query("mahalanobis", """WITH m AS (SELECT avg(l_quantity) a, avg(l_discount) b, var_samp(l_quantity) sa, var_samp(l_discount) sb,
covar_samp(l_quantity,l_discount) c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(sqrt(((l_quantity-a)*(l_quantity-a)*sb - 2*(l_quantity-a)*(l_discount-b)*c
+ (l_discount-b)*(l_discount-b)*sa)/(sa*sb-c*c)),6) AS distance FROM lineitem, m""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(S.mahalanobis(df, ["l_quantity", "l_discount"])).select("l_orderkey", "l_linenumber", "distance")


@query("cumulative_share", """WITH c AS (SELECT value, sum(value) OVER (ORDER BY value, event_id ROWS UNBOUNDED PRECEDING)
/ sum(value) OVER () AS t FROM events) SELECT floor(count(CASE WHEN t<0.2 THEN 1 END)::DOUBLE/count(*)*100)::INTEGER AS percent FROM c""")
def _(spark, sf_dir):
    return S.cum_share(table(spark, sf_dir, "events"), "value", 0.2)


PREDICTED = """(SELECT event_id, event_type AS truth, CASE WHEN value<5 THEN 'click' WHEN value<12 THEN event_type ELSE 'view' END AS predicted
FROM events)"""


def _predicted(spark, sf_dir):
    guess = F.when(F.col("value") < 5, "click").when(F.col("value") < 12, F.col("event_type")).otherwise("view")
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("truth"), guess.alias("predicted"))


@query("accuracy", f"""SELECT sum((truth=predicted)::INTEGER)::BIGINT AS hits, count(*) AS n,
round(avg((truth=predicted)::INTEGER),6) AS accuracy FROM {PREDICTED}""")
def _(spark, sf_dir):
    return rounded(S.accuracy(_predicted(spark, sf_dir), "truth", "predicted"))


@query("confusion_matrix", f"SELECT truth, predicted, count(*) AS n FROM {PREDICTED} GROUP BY 1,2")
def _(spark, sf_dir):
    return S.confusion(_predicted(spark, sf_dir), "truth", "predicted")


@query("classification_report", f"""WITH p AS (SELECT * FROM {PREDICTED}),
c AS (SELECT truth AS k FROM p UNION SELECT predicted FROM p),
a AS (SELECT k, (SELECT count(*) FROM p WHERE truth=k AND predicted=k)::DOUBLE AS hits,
  (SELECT count(*) FROM p WHERE predicted=k) AS named, (SELECT count(*) FROM p WHERE truth=k) AS support FROM c),
m AS (SELECT k, support, CASE WHEN named>0 THEN hits/named ELSE 0 END AS pr, CASE WHEN support>0 THEN hits/support ELSE 0 END AS rc FROM a),
f AS (SELECT *, CASE WHEN pr+rc>0 THEN 2*pr*rc/(pr+rc) ELSE 0 END AS f1 FROM m)
SELECT k AS class, round(pr,6) AS precision, round(rc,6) AS recall, round(f1,6) AS f1, support::BIGINT AS support FROM f UNION ALL
SELECT 'macro avg', round(avg(pr),6), round(avg(rc),6), round(avg(f1),6), sum(support)::BIGINT FROM f UNION ALL
SELECT 'weighted avg', round(sum(pr*support)/sum(support),6), round(sum(rc*support)/sum(support),6),
round(sum(f1*support)/sum(support),6), sum(support)::BIGINT FROM f""")
def _(spark, sf_dir):
    return rounded(S.classification_report(_predicted(spark, sf_dir), "truth", "predicted"))


@query("log_loss", """SELECT round(avg(-ln(greatest(CASE WHEN event_type='click' THEN p ELSE 1-p END,1e-15))),6) AS log_loss
FROM (SELECT event_type, 1/(1+exp(-(value-10)/10)) AS p FROM events)""")
def _(spark, sf_dir):
    p = 1 / (1 + F.exp(-(F.col("value") - 10) / 10))
    df = table(spark, sf_dir, "events").select((F.col("event_type") == "click").alias("y"), p.alias("p"))
    return rounded(S.log_loss(df, "y", "p"))


@query("two_class_argmax", """SELECT l_returnflag, CASE WHEN l_discount*10 < 0.5 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(spark, sf_dir):
    from analystry.functions.numeric import two_class_argmax
    predicted = two_class_argmax(F.col("l_discount") * 10).alias("predicted")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", predicted).agg(F.count(F.lit(1)).alias("n"))


@query("corpus_megabytes", """SELECT lang, round(sum(strlen(text))/1e6,6) AS megabytes FROM documents GROUP BY lang""")
def _(spark, sf_dir):
    from analystry.functions.text import megabytes
    return rounded(table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(megabytes(F.col("text"))).alias("megabytes")))
