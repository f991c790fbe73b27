"""Multi-variable scores, quadrants and outliers on order lines and embeddings."""

from pyspark.sql import functions as F

from analystry.plans import outliers as U
from analystry.plans import poi as P
from analystry.plans import quadrants as Q
from analystry.registry.book import query, rounded
from analystry.session import table

VARIABLES = ["user_id", "k"]


def lines(spark, sf_dir):
    """Order lines for the quadrants; line numbers repeat within an order, so part and supplier join the key."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key")
    return table(spark, sf_dir, "lineitem").select(key, "l_quantity", "l_discount", "l_extendedprice")


def visits(spark, sf_dir):
    """Events as scored items: user number, k from the properties and the hour as variables, value as size."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.hour("ts").alias("h"), "value")


RANKED = """k AS (SELECT event_id, user_id, CAST(props->>'k' AS BIGINT) AS k, value FROM events
      WHERE value >= (SELECT quantile_cont(value,0.2) FROM events)),
r AS (SELECT *, (row_number() OVER (ORDER BY user_id, event_id)-1)::DOUBLE/count(*) OVER () AS a,
      (row_number() OVER (ORDER BY k, event_id)-1)::DOUBLE/count(*) OVER () AS b,
      ceil(10*row_number() OVER (ORDER BY value, event_id)::DOUBLE/count(*) OVER ())::INTEGER AS fin FROM k),
s AS (SELECT *, greatest(ceil(round(10*power(a*b,0.5),9)),1)::INTEGER AS score FROM r)"""


def scored(spark, sf_dir, method="Rank"):
    return P.scored_rows(visits(spark, sf_dir), "event_id", VARIABLES, "value", 0.2, method=method)


@query("poi_rank_scores", f"WITH {RANKED} SELECT event_id, round(a,6) AS user_id_share, round(b,6) AS k_share, score, fin FROM s")
def _(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("event_id", "user_id_share", "k_share", "score", "fin"))


@query("poi_rank_counts", f"WITH {RANKED} SELECT fin, " + ", ".join(
    f'count(*) FILTER (score={i}) AS "{i}"' for i in range(1, 11)) + " FROM s GROUP BY fin")
def _(spark, sf_dir):
    return P.count_report(scored(spark, sf_dir))


@query("poi_rank_by_impact", f"WITH {RANKED} SELECT fin, count(*) AS n, round(sum(value),2) AS total FROM s GROUP BY fin")
def _(spark, sf_dir):
    return rounded(P.impact_report(scored(spark, sf_dir), "value"), 2)


@query("poi_rank_means", f"WITH {RANKED} SELECT fin, " + ", ".join(
    f'round(avg(k) FILTER (score={i}),6) AS "{i}"' for i in range(1, 11)) + " FROM s GROUP BY fin")
def _(spark, sf_dir):
    return rounded(P.mean_report(scored(spark, sf_dir), "k"))


@query("poi_mahalanobis", f"""WITH {RANKED},
m AS (SELECT avg(a) ma, avg(b) mb, var_samp(a) sa, var_samp(b) sb, covar_samp(a,b) c FROM r),
d AS (SELECT event_id, fin, sqrt(((a-ma)*(a-ma)*sb - 2*(a-ma)*(b-mb)*c + (b-mb)*(b-mb)*sa)/(sa*sb-c*c)) AS d FROM r, m)
SELECT event_id, fin, ceil(round(10*(d-min(d) OVER ())/(max(d) OVER ()-min(d) OVER ()),9))::INTEGER AS score FROM d""")
def _(spark, sf_dir):
    return scored(spark, sf_dir, "Mahalanobis").select("event_id", "fin", "score")


@query("poi_kmeans")
def _(spark, sf_dir):
    return scored(spark, sf_dir, "KMeans").groupBy("score").agg(F.count(F.lit(1)).alias("n"))


@query("poi_bisecting")
def _(spark, sf_dir):
    return scored(spark, sf_dir, "Hierarchical").groupBy("score").agg(F.count(F.lit(1)).alias("n"))


@query("poi_projection")
def _(spark, sf_dir):
    three = [*VARIABLES, "h"]
    rows = P.scored_rows(visits(spark, sf_dir), "event_id", three, "value", 0.2)
    return rounded(P.projection(rows, "event_id", three), 4)


POINTS = """k AS (SELECT concat_ws('-',l_orderkey,l_linenumber,l_partkey,l_suppkey) AS key, * FROM lineitem WHERE l_extendedprice > (SELECT quantile_cont(l_extendedprice,0.25) FROM lineitem)),
q AS (SELECT quantile_cont(l_quantity,0.5) xc, quantile_cont(l_discount,0.5) yc, quantile_cont(l_quantity,0.01) xl, max(l_quantity) xh,
      quantile_cont(l_discount,0.01) yl, max(l_discount) yh, min(l_extendedprice) zl, max(l_extendedprice) zh FROM k),
p AS (SELECT key, least(greatest(l_quantity,xl),xh) AS x, least(greatest(l_discount,yl),yh) AS y, (l_extendedprice-zl)/(zh-zl) AS z, xc, yc FROM k, q),
c AS (SELECT key, x, y, z, CASE WHEN x<xc THEN CASE WHEN y<yc THEN 'gray' ELSE 'green' END ELSE CASE WHEN y<yc THEN 'orange' ELSE 'red' END END AS colour FROM p)"""


@query("quadrant_points", f"WITH {POINTS} SELECT key, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z, colour FROM c")
def _(spark, sf_dir):
    return rounded(Q.quadrant_points(lines(spark, sf_dir), "key", "l_quantity", "l_discount", "l_extendedprice", 0.25))


@query("quadrant_red_rows", f"""WITH {POINTS} SELECT key, l_extendedprice FROM (SELECT concat_ws('-',l_orderkey,l_linenumber,l_partkey,l_suppkey) AS key, l_extendedprice FROM lineitem)
WHERE key IN (SELECT key FROM c WHERE colour='red') ORDER BY l_extendedprice DESC, key LIMIT 5""")
def _(spark, sf_dir):
    rows = lines(spark, sf_dir)
    points = Q.quadrant_points(rows, "key", "l_quantity", "l_discount", "l_extendedprice", 0.25)
    return Q.red_rows(rows, points, "key", "l_extendedprice").select("key", "l_extendedprice")


DIMS = [f"f{i}" for i in range(64)]
OUTLIER = ("""e AS (SELECT vec_id, """ + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(64)) + """ FROM embeddings),
q AS (SELECT """ + ", ".join(f"median(f{i}) m{i}, quantile_cont(f{i},0.975)-quantile_cont(f{i},0.025) w{i}" for i in range(64)) + """ FROM e),
s AS (SELECT vec_id, [""" + ", ".join(f"(f{i}-m{i})/w{i}" for i in range(64)) + """] AS v FROM e, q),
d AS (SELECT a.vec_id, list_distance(a.v,b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v,b.v), b.vec_id) AS k
      FROM s a, s b WHERE a.vec_id<>b.vec_id),
l AS (SELECT vec_id, avg(d) AS loc FROM d WHERE k<=49 GROUP BY 1),
c AS (SELECT quantile_cont(loc,0.01) lo, quantile_cont(loc,0.99) hi FROM l),
w AS (SELECT vec_id, (least(greatest(loc,lo),hi)-lo)/(hi-lo) AS loc FROM l, c)""")


def outliers(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    e = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])
    return U.outlier_scores(e, "vec_id", DIMS)


@query("outlier_scores", f"WITH {OUTLIER} SELECT vec_id, round(loc,6) AS loc FROM w")
def _(spark, sf_dir):
    return rounded(outliers(spark, sf_dir))


@query("outlier_levels", f"""WITH {OUTLIER} SELECT i::INTEGER AS level, round(CASE i WHEN 0 THEN quantile_cont(loc*1.1,0) WHEN 1 THEN quantile_cont(loc*1.1,0.25)
WHEN 2 THEN quantile_cont(loc*1.1,0.5) WHEN 3 THEN quantile_cont(loc*1.1,0.75) ELSE quantile_cont(loc*1.1,1) END,6) AS value
FROM w, generate_series(0,4) t(i) GROUP BY i""")
def _(spark, sf_dir):
    return rounded(U.score_levels(outliers(spark, sf_dir)))
