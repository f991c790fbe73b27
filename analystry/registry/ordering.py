"""Running sums, ranks, bins, shifts and quantiles over whole tables."""

from pyspark.sql import functions as F

from analystry.operators import ordering as O
from analystry.operators import quantiles as Q
from analystry.registry.book import query, rounded
from analystry.session import table


def line_key():
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")


@query("running_sum", """WITH g AS (SELECT value, count(*) AS n, sum(user_id) AS s FROM events GROUP BY value)
SELECT value, n, CAST(s AS BIGINT) AS s, CAST(sum(n) OVER w AS BIGINT) AS cum_n, CAST(sum(s) OVER w AS BIGINT) AS cum_s,
CAST(sum(n) OVER () AS BIGINT) AS tot_n, CAST(sum(s) OVER () AS BIGINT) AS tot_s FROM g WINDOW w AS (ORDER BY value)""")
def _(spark, sf_dir):
    return O.prefix_sum(table(spark, sf_dir, "events"), "value", {"n": F.lit(1), "s": F.col("user_id")})


@query("average_rank", """SELECT DISTINCT l_extendedprice, count(*) OVER p AS n,
rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER p - 1)/2.0::DOUBLE AS avg_rank,
round((rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER p - 1)/2.0::DOUBLE)/count(*) OVER (),6) AS rank_share
FROM lineitem WINDOW p AS (PARTITION BY l_extendedprice)""")
def _(spark, sf_dir):
    return rounded(O.average_rank(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query("percent_rank_ordinal", """SELECT l_orderkey*10+l_linenumber AS key, l_quantity,
round((row_number() OVER (ORDER BY l_quantity, l_orderkey*10+l_linenumber)-1)::DOUBLE/count(*) OVER (),6) AS pr FROM lineitem""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(line_key(), "l_quantity")
    return rounded(O.percent_rank_ordinal(df, "l_quantity", "key", "pr"))


@query("rank_bin", """SELECT l_orderkey*10+l_linenumber AS key, CAST(ceil(10*row_number() OVER
(ORDER BY l_extendedprice, l_orderkey*10+l_linenumber)::DOUBLE/count(*) OVER ()) AS INTEGER) AS bin FROM lineitem""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(line_key(), "l_extendedprice")
    return O.rank_bin(df, "l_extendedprice", "key", 10, "bin").select("key", "bin")


@query("sort_permutation", """SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS pos FROM events""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value")
    return O.ordered_index(df, ["value", "event_id"], name="pos").select("event_id", "pos")


@query("row_position_per_user", """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos
FROM events""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "event_id")
    return O.ordered_index(df, ["event_id"], ["user_id"], name="pos")


@query("echo_shift", """SELECT event_id, (event_type='click')::INTEGER AS x,
lag((event_type='click')::INTEGER, 3, 0) OVER (ORDER BY event_id) AS y FROM events""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "click").cast("int").alias("x"))
    return O.shift(df, "x", ["event_id"], 3, "y")


@query("echo_shift_per_user", """SELECT user_id, event_id, value,
lag(value, 2, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS earlier FROM events""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return O.shift(df, "value", ["event_id"], 2, "earlier", by=["user_id"])


SUBSERIES = """
i AS (SELECT (event_type='click')::INTEGER AS x, row_number() OVER (ORDER BY event_id)-1 AS idx, count(*) OVER () AS n FROM events),
s AS (SELECT x, idx, (n//5) AS size, idx//(n//5) AS series_id, idx%(n//5) AS pos FROM i WHERE idx < (n//5)*5),
w AS (SELECT *, pos//15 AS win FROM s WHERE (pos//15+1)*15 <= size)"""


@query("subseries_windows", f"""WITH {SUBSERIES}
SELECT CAST(series_id AS INTEGER) AS series_id, win, string_agg(x::VARCHAR, '' ORDER BY pos) AS xs FROM w GROUP BY 1,2""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "click").cast("int").alias("x"))
    cut = O.subseries(df, ["event_id"], parts=5, window=15)
    # a window holds exactly 15 rows
    windows = cut.groupBy("series_id", "win").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("rows"))
    return windows.select("series_id", "win", F.array_join(F.col("rows.x"), "").alias("xs"))


@query("every_100th_row", """SELECT event_id, value, pos FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id)-1 AS pos
FROM events) WHERE pos%100=0""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value")
    return O.every_nth(df, ["event_id"], 100).withColumnRenamed("idx", "pos")


@query("top_share_per_group", """WITH r AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER
(PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rnk FROM customer)
SELECT c_nationkey, c_custkey, c_acctbal, CAST(rnk AS INTEGER) AS rnk,
round(c_acctbal/sum(c_acctbal) OVER (PARTITION BY c_nationkey),2) AS share FROM r WHERE rnk<=10""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return O.top_share(df, ["c_nationkey"], "c_acctbal", "c_custkey", 10)


@query("quantiles", """SELECT 'l_quantity' AS feature, count(*) AS n, round(quantile_cont(l_quantity,0.025),6) AS q0,
round(quantile_cont(l_quantity,0.33),6) AS q1, round(quantile_cont(l_quantity,0.99),6) AS q2 FROM lineitem UNION ALL
SELECT 'l_extendedprice', count(*), round(quantile_cont(l_extendedprice,0.025),6),
round(quantile_cont(l_extendedprice,0.33),6), round(quantile_cont(l_extendedprice,0.99),6) FROM lineitem""")
def _(spark, sf_dir):
    return rounded(Q.column_quantiles(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], [0.025, 0.33, 0.99]))


@query("quantiles_per_group", """SELECT event_type, count(*) AS n, round(quantile_cont(value,0.25),6) AS q0,
round(quantile_cont(value,0.5),6) AS q1, round(quantile_cont(value,0.95),6) AS q2 FROM events GROUP BY 1""")
def _(spark, sf_dir):
    return rounded(Q.grouped_quantiles(table(spark, sf_dir, "events"), "value", [0.25, 0.5, 0.95], ["event_type"]))


@query("quantile_filter_le", """SELECT event_id, value FROM events WHERE value <= (SELECT quantile_cont(value,0.99) FROM events)""")
def _(spark, sf_dir):
    return Q.quantile_filter(table(spark, sf_dir, "events").select("event_id", "value"), "value", 0.99)


@query("mass_cut_strict", """SELECT event_id, value FROM events WHERE value > (SELECT quantile_cont(value,0.3) FROM events)""")
def _(spark, sf_dir):
    return Q.quantile_filter(table(spark, sf_dir, "events").select("event_id", "value"), "value", 0.3, "gt")


@query("mass_cut_inclusive", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity >= (SELECT quantile_cont(l_quantity,0.4) FROM lineitem)""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return Q.quantile_filter(df, "l_quantity", 0.4, "ge")


@query("winsorize", """WITH q AS (SELECT quantile_cont(value,0.025) lo, quantile_cont(value,0.975) hi FROM events)
SELECT event_id, round(least(greatest(value,lo),hi),6) AS value FROM events, q""")
def _(spark, sf_dir):
    return rounded(Q.winsorize(table(spark, sf_dir, "events").select("event_id", "value"), {"value": (0.025, 0.975)}))


@query("robust_scale", """WITH q AS (SELECT quantile_cont(l_quantity,0.025) a, median(l_quantity) b, quantile_cont(l_quantity,0.975) c,
quantile_cont(l_extendedprice,0.025) d, median(l_extendedprice) e, quantile_cont(l_extendedprice,0.975) f FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity-b)/(c-a),6) AS l_quantity, round((l_extendedprice-e)/(f-d),6) AS l_extendedprice
FROM lineitem, q""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(Q.robust_scale(df, ["l_quantity", "l_extendedprice"]))


@query("min_max_scale", """SELECT event_id, round((value-min(value) OVER ())/(max(value) OVER ()-min(value) OVER ()),6) AS value FROM events""")
def _(spark, sf_dir):
    return rounded(Q.min_max_scale(table(spark, sf_dir, "events").select("event_id", "value"), ["value"]))


@query("standard_scale", """SELECT event_id, round((value-avg(value) OVER ())/stddev_pop(value) OVER (),6) AS value FROM events""")
def _(spark, sf_dir):
    return rounded(Q.standard_scale(table(spark, sf_dir, "events").select("event_id", "value"), ["value"]))


@query("max_abs_scale", """SELECT c_custkey, round(c_acctbal/max(abs(c_acctbal)) OVER (),6) AS c_acctbal FROM customer""")
def _(spark, sf_dir):
    return rounded(Q.max_abs_scale(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


@query("box_summary", """WITH q AS (SELECT count(*) n, quantile_cont(value,0.25) a, quantile_cont(value,0.5) b, quantile_cont(value,0.75) c FROM events)
SELECT max(n) AS n, round(max(a),6) AS q1, round(max(b),6) AS median, round(max(c),6) AS q3,
min(CASE WHEN value>=a-1.5*(c-a) THEN value END) AS whisker_low, max(CASE WHEN value<=c+1.5*(c-a) THEN value END) AS whisker_high,
count(CASE WHEN value<a-1.5*(c-a) OR value>c+1.5*(c-a) THEN 1 END) AS outliers FROM events, q""")
def _(spark, sf_dir):
    return rounded(Q.box_summary(table(spark, sf_dir, "events"), "value"))
