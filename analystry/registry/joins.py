"""Semi, anti, lookup and nearest-neighbour joins."""

from pyspark.sql import functions as F

from analystry.operators import neighbours as K
from analystry.registry.book import query, rounded
from analystry.session import table


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query("semi_join", "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(keys, "o_custkey", "left_semi")


@query("anti_join", """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F')""")
def _(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(stored, "c_custkey", "left_anti")


@query("lookup_by_built_key", """SELECT event_id, n_name FROM events JOIN
(SELECT n_name, CAST(n_nationkey AS VARCHAR)||'2' AS code FROM nation) ON CAST(user_id%25 AS VARCHAR)||'2' = code""")
def _(spark, sf_dir):
    dim = table(spark, sf_dir, "nation").select("n_name", F.concat("n_nationkey", F.lit("2")).alias("code"))
    e = table(spark, sf_dir, "events").withColumn("code", F.concat(F.col("user_id") % 25, F.lit("2")))
    return e.join(dim, "code").select("event_id", "n_name")


@query("modular_lookup", """WITH d AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey)-1 AS i, count(*) OVER () AS n FROM nation)
SELECT event_id, a.n_name AS first_name, b.n_name AS second_name FROM events JOIN d a ON event_id % a.n = a.i
JOIN d b ON (event_id+30) % b.n = b.i""")
def _(spark, sf_dir):
    from pyspark.sql import Window
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    size = F.lit(nation.count())  # a fixed table of 25 rows: one window and a broadcast
    d = F.broadcast(nation.select("n_name", (F.row_number().over(Window.orderBy("n_nationkey")) - 1).alias("i")))
    e = table(spark, sf_dir, "events").select("event_id")
    e = e.select("event_id", F.pmod("event_id", size).alias("i"), F.pmod(F.col("event_id") + 30, size).alias("j"))
    a = d.select("i", F.col("n_name").alias("first_name"))
    b = d.select(F.col("i").alias("j"), F.col("n_name").alias("second_name"))
    return e.join(a, "i").join(b, "j").select("event_id", "first_name", "second_name")


@query("feature_block_stack", """SELECT vec_id, embedding[1]::DOUBLE AS a0, embedding[2]::DOUBLE AS a1, label::DOUBLE AS b0,
(vec_id*2)::DOUBLE AS b1 FROM embeddings""")
def _(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    e = table(spark, sf_dir, "embeddings")
    left = e.select("vec_id", array_to_vector(F.slice("embedding", 1, 2)).alias("a"))
    right = e.select("vec_id", array_to_vector(F.array(F.col("label").cast("double"), F.col("vec_id") * 2.0)).alias("b"))
    stacked = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(left.join(right, "vec_id"))
    f = vector_to_array("f")
    return stacked.select("vec_id", *[f[i].alias(n) for i, n in enumerate(("a0", "a1", "b0", "b1"))])


@query("arrays_zip", """SELECT doc_id, w AS word, i::INTEGER AS pos FROM (SELECT doc_id, unnest(string_split(text,' ')) AS w,
generate_subscripts(string_split(text,' '),1) AS i FROM documents)""")
def _(spark, sf_dir):
    words = F.split("text", " ")
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("word"), F.sequence(F.lit(1), F.size(words)).alias("pos"))
    return d.select("doc_id", F.explode(F.arrays_zip("word", "pos")).alias("p")).select("doc_id", "p.word", "p.pos")


KNN = """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS base_id, a.label AS ql, b.label AS bl,
list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM embeddings a, embeddings b WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, base_id) AS rnk FROM p)"""


@query("nearest_distances", KNN.format(where="a.vec_id<>b.vec_id") +
       " SELECT query_id, base_id, round(dist,6) AS dist, rnk::INTEGER AS rnk FROM r WHERE rnk<=10")
def _(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded(K.knn_join(e, e, 10, "vec_id", "vec_id", "v", exclude_same_key=True))


@query("mean_neighbour_distance", KNN.format(where="a.vec_id<>b.vec_id") +
       " SELECT query_id, round(avg(dist),6) AS loc FROM r WHERE rnk<=49 GROUP BY query_id")
def _(spark, sf_dir):
    return rounded(K.mean_neighbour_distance(embeddings(spark, sf_dir), "vec_id", "v"))


@query("knn_classifier", KNN.format(where="a.vec_id%3=0 AND b.vec_id%3<>0") +
       """, v AS (SELECT query_id, bl, count(*) AS n FROM r WHERE rnk<=10 GROUP BY 1,2),
b AS (SELECT query_id, bl, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, bl) AS i FROM v)
SELECT query_id AS vec_id, bl AS predicted FROM b WHERE i=1""")
def _(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    held_out = F.col("vec_id") % 3 == 0
    return K.knn_classify(e.where(held_out), e.where(~held_out), 10, "vec_id", "v", "label")


@query("nearest_centroid", """WITH t AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, generate_series(1,64) g(i)),
c AS (SELECT label, i, avg(x) AS m FROM t WHERE vec_id%3<>0 GROUP BY 1,2),
d AS (SELECT vec_id, c.label AS predicted, sqrt(sum((x-m)*(x-m))) AS dist FROM t JOIN c USING (i) WHERE vec_id%3=0 GROUP BY 1,2)
SELECT vec_id, predicted, round(dist,6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, predicted) AS k FROM d)
WHERE k=1""")
def _(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    held_out = F.col("vec_id") % 3 == 0
    return rounded(K.nearest_centroid(e.where(held_out), e.where(~held_out), "vec_id", "v", "label"))


@query("nearest_on_grid", """WITH l AS (SELECT min(c_acctbal)-0.05*(max(c_acctbal)-min(c_acctbal)) xl, max(c_acctbal)+0.05*(max(c_acctbal)-min(c_acctbal)) xh,
min(c_nationkey)-0.05::DOUBLE*(max(c_nationkey)-min(c_nationkey)) yl, max(c_nationkey)+0.05::DOUBLE*(max(c_nationkey)-min(c_nationkey)) yh FROM customer),
g AS (SELECT i*15+j AS cell, xl+i*(xh-xl)/14 AS x, yl+j*(yh-yl)/14 AS y FROM l, generate_series(0,14) a(i), generate_series(0,14) b(j)),
d AS (SELECT cell, c_mktsegment, sqrt((x-c_acctbal)*(x-c_acctbal)+(y-c_nationkey)*(y-c_nationkey)) AS dist, c_custkey FROM g, customer),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY dist, c_custkey) AS k FROM d)
SELECT cell, c_mktsegment, round(dist,6) AS dist FROM r WHERE k=1""")
def _(spark, sf_dir):
    from analystry.sources.generated import grid2d
    points = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    grid = grid2d(points, "c_acctbal", "c_nationkey", 15).withColumn("v", F.array("x", "y"))
    points = points.withColumn("v", F.array("c_acctbal", "c_nationkey"))
    return rounded(K.nearest_value(grid, points, "cell", "c_custkey", "v", "c_mktsegment"))
