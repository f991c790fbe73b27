"""Score against label: events.value against purchases, document length against quality."""

from pyspark.sql import functions as F

from analystry.operators import scorecard as S
from analystry.registry.book import query, rounded
from analystry.session import table

COUNTS = """
g AS (SELECT value AS x, sum(CASE WHEN event_type='purchase' THEN 0 ELSE 1 END) AS n0,
             sum(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) AS n1 FROM events GROUP BY value),
c AS (SELECT x, n0, n1, sum(n0) OVER w AS c0, sum(n1) OVER w AS c1,
             sum(n0) OVER () AS t0, sum(n1) OVER () AS t1
      FROM g WINDOW w AS (ORDER BY x)),
d AS (SELECT x, n0+n1 AS n, n0, n1, c0, c1, t0, t1, c0*1.0::DOUBLE/t0 AS cdf0, c1*1.0::DOUBLE/t1 AS cdf1 FROM c)
"""


def scored(spark, sf_dir):
    purchase = (F.col("event_type") == "purchase").alias("y")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value", purchase)


@query("ks_curve", f"""WITH {COUNTS}
SELECT x, CAST(n AS BIGINT) AS n, round(cdf0,6) AS cdf0, round(cdf1,6) AS cdf1, round(abs(cdf0-cdf1),6) AS dist FROM d""")
def _(spark, sf_dir):
    return rounded(S.ks_curve(scored(spark, sf_dir), "value", "y"))


@query("ks_stats", f"""WITH {COUNTS},
s AS (SELECT max(abs(cdf0-cdf1)) AS ks, sum(abs(cdf0-cdf1)*n)/sum(n) AS ks_mean,
             sum(CASE WHEN cdf0>cdf1 THEN n ELSE 0 END)*1.0::DOUBLE/sum(n) AS p FROM d)
SELECT round(ks,6) AS ks, round(ks_mean,6) AS ks_mean, round(p,6) AS ks_stability,
       round(CASE WHEN p>0 AND p<1 THEN -(p*ln(p)+(1-p)*ln(1-p)) ELSE 0 END,6) AS ks_entropy FROM s""")
def _(spark, sf_dir):
    return rounded(S.ks_stats(scored(spark, sf_dir), "value", "y"))


@query("ks_by_user", """
WITH g AS (SELECT user_id, value AS x, sum(CASE WHEN event_type='purchase' THEN 0 ELSE 1 END) AS n0,
             sum(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) AS n1 FROM events GROUP BY user_id, value),
c AS (SELECT user_id, x, sum(n0) OVER w AS c0, sum(n1) OVER w AS c1, sum(n0) OVER (PARTITION BY user_id) AS t0,
             sum(n1) OVER (PARTITION BY user_id) AS t1 FROM g WINDOW w AS (PARTITION BY user_id ORDER BY x))
SELECT user_id, round(max(CASE WHEN t0>0 AND t1>0 THEN abs(c0*1.0::DOUBLE/t0 - c1*1.0::DOUBLE/t1) END),6) AS ks
FROM c GROUP BY user_id""")
def _(spark, sf_dir):
    return rounded(S.ks_stats(scored(spark, sf_dir), "value", "y", ["user_id"]).select("user_id", "ks"))


@query("roc_curve", f"""WITH {COUNTS}
SELECT x AS threshold, round((t0-c0+n0)*1.0::DOUBLE/t0,6) AS fpr, round((t1-c1+n1)*1.0::DOUBLE/t1,6) AS tpr FROM d""")
def _(spark, sf_dir):
    return rounded(S.roc_curve(scored(spark, sf_dir), "value", "y"))


@query("auc", f"""WITH {COUNTS}
SELECT round(sum(n1*(c0-n0/2.0::DOUBLE))/(max(t0)::DOUBLE*max(t1)),6) AS auc FROM d""")
def _(spark, sf_dir):
    return rounded(S.auc(scored(spark, sf_dir), "value", "y"))


@query("auc_quality_by_length", """
WITH e AS (SELECT n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id)),
r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1)/2.0::DOUBLE AS rk FROM e)
SELECT round((sum(CASE WHEN y=1 THEN rk ELSE 0 END) - sum(y)*(sum(y)+1)/2.0::DOUBLE)
             / (sum(y)::DOUBLE*sum(1-y)),6) AS auc FROM r""")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return rounded(S.auc(docs.join(table(spark, sf_dir, "labels"), "doc_id"), "n_chars", "quality"))


@query("ks_roc_report", """
WITH e AS (SELECT CASE WHEN event_id % 5 < 3 THEN 'train' ELSE 'test' END AS sp, value AS x,
                  CASE WHEN event_type='purchase' THEN 1 ELSE 0 END AS y FROM events),
g AS (SELECT sp, x, sum(1-y) AS n0, sum(y) AS n1 FROM e GROUP BY sp, x),
c AS (SELECT *, sum(n0) OVER w AS c0, sum(n1) OVER w AS c1, sum(n0) OVER (PARTITION BY sp) AS t0,
             sum(n1) OVER (PARTITION BY sp) AS t1 FROM g WINDOW w AS (PARTITION BY sp ORDER BY x)),
r AS (SELECT sp, max(abs(c0*1.0::DOUBLE/t0-c1*1.0::DOUBLE/t1)) AS ks,
             sum(n1*(c0-n0/2.0::DOUBLE))/(max(t0)::DOUBLE*max(t1)) AS auc FROM c GROUP BY sp)
SELECT round(max(CASE WHEN sp='train' THEN ks END),6) AS ks1, round(max(CASE WHEN sp='train' THEN auc END),6) AS roc1,
       round(max(CASE WHEN sp='test' THEN ks END),6) AS ks2, round(max(CASE WHEN sp='test' THEN auc END),6) AS roc2 FROM r""")
def _(spark, sf_dir):
    df = scored(spark, sf_dir)
    in_train = F.col("event_id") % 5 < 3
    return rounded(S.ks_roc_report(df.where(in_train), df.where(~in_train), "value", "y"))


WOE = """
WITH r AS (SELECT CASE WHEN event_type='purchase' THEN 1 ELSE 0 END AS y,
   (rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1)/2.0::DOUBLE) / count(*) OVER () AS rs FROM events),
b AS (SELECT CAST(round_even(rs*{bins},0) AS INTEGER) AS bucket, sum(y) AS y, sum(1-y) AS noty FROM r GROUP BY 1),
s AS (SELECT bucket, y, noty, y::DOUBLE/sum(y) OVER () AS pery, noty::DOUBLE/sum(noty) OVER () AS pernoty FROM b),
o AS (SELECT *, CASE WHEN pernoty>0 THEN pery/pernoty END AS odds FROM s),
v AS (SELECT *, CASE WHEN odds>0 THEN ln(odds) END AS woe FROM o)
SELECT bucket, CAST(y AS BIGINT) AS y, CAST(noty AS BIGINT) AS noty, round(pery,6) AS pery, round(pernoty,6) AS pernoty,
       round(odds,6) AS odds, round(woe,6) AS woe, round(woe*{diff},6) AS iv FROM v"""


@query("woe_iv", WOE.format(bins=10, diff="abs(pery-pernoty)"))
def _(spark, sf_dir):
    return rounded(S.weight_of_evidence(scored(spark, sf_dir), "value", "y"))


@query("woe_iv_signed_20", WOE.format(bins=20, diff="(pery-pernoty)"))
def _(spark, sf_dir):
    return rounded(S.weight_of_evidence(scored(spark, sf_dir), "value", "y", bins=20, signed=True))


@query("ks_histogram_report", """
WITH q AS (SELECT quantile_cont(value,0.025) AS lo, quantile_cont(value,0.975) AS hi FROM events),
e AS (SELECT least(greatest(value,lo),hi) AS x, CASE WHEN event_type='purchase' THEN 1 ELSE 0 END AS y FROM events, q),
g AS (SELECT x, sum(1-y) AS n0, sum(y) AS n1 FROM e GROUP BY x),
c AS (SELECT x, n0+n1 AS n, sum(n0) OVER w *1.0::DOUBLE/sum(n0) OVER () AS a, sum(n1) OVER w *1.0::DOUBLE/sum(n1) OVER () AS b
      FROM g WINDOW w AS (ORDER BY x)),
s AS (SELECT max(abs(a-b)) AS ks, sum(abs(a-b)*n)/sum(n) AS ks_mean,
             sum(CASE WHEN a>b THEN n ELSE 0 END)*1.0::DOUBLE/sum(n) AS p FROM c)
SELECT round(ks,6) AS ks, round(ks_mean,6) AS ks_mean, round(p,6) AS ks_stability,
       round(CASE WHEN p>0 AND p<1 THEN -(p*ln(p)+(1-p)*ln(1-p)) ELSE 0 END,6) AS ks_entropy FROM s""")
def _(spark, sf_dir):
    return rounded(S.ks_histogram_report(scored(spark, sf_dir), "value", "y"))


DIMS = [f"f{i}" for i in range(64)]
CLASSES = list(range(10))


def vectors(spark, sf_dir, dims=64):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(dims)])


@query("ks_panel", """
WITH l AS (SELECT 'f'||(i-1) AS feature, embedding[i]::DOUBLE AS x, label FROM embeddings, generate_series(1,64) t(i)),
k AS (SELECT feature, x, c AS class, CASE WHEN label=c THEN 1 ELSE 0 END AS y FROM l, generate_series(0,9) u(c)),
g AS (SELECT feature, class, x, sum(1-y) AS n0, sum(y) AS n1 FROM k GROUP BY 1,2,3),
c AS (SELECT *, sum(n0) OVER w AS c0, sum(n1) OVER w AS c1, sum(n0) OVER (PARTITION BY feature, class) AS t0,
             sum(n1) OVER (PARTITION BY feature, class) AS t1 FROM g WINDOW w AS (PARTITION BY feature, class ORDER BY x))
SELECT feature, CAST(class AS INTEGER) AS class, round(max(abs(c0*1.0::DOUBLE/t0-c1*1.0::DOUBLE/t1)),6) AS ks,
       round(sum(n1*(c0-n0/2.0::DOUBLE))/(max(t0)::DOUBLE*max(t1)),6) AS auc FROM c GROUP BY feature, class""")
def _(spark, sf_dir):
    return rounded(S.ks_panel(vectors(spark, sf_dir), DIMS, "label", CLASSES))
