"""Row-level work: columns, filters, scalar functions, unions, and the plain aggregates."""

from pyspark.sql import functions as F

from analystry.functions import numeric as N
from analystry.functions import text as T
from analystry.operators import columns as C
from analystry.registry.book import query, rounded
from analystry.session import spread, table

W = r"[\p{L}\p{N}_]"


# ---- columns ---------------------------------------------------------------------------------

@query("select_columns", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("constant_columns", "SELECT n_nationkey, n_name, 'am' AS state, 'norte' AS region FROM nation")
def _(spark, sf_dir):
    return C.with_constants(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), state="am", region="norte")


@query("rename_columns", "SELECT n_nationkey AS code, n_name AS name, n_regionkey AS region FROM nation")
def _(spark, sf_dir):
    return table(spark, sf_dir, "nation").toDF("code", "name", "region")


@query("drop_matching", """SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_discount, l_returnflag
FROM lineitem""")
def _(spark, sf_dir):
    return C.drop_matching(table(spark, sf_dir, "lineitem"), "(.*tax|.*date|.*quantity)$|l_line")


@query("drop_containing", """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_tax, l_returnflag FROM lineitem""")
def _(spark, sf_dir):
    return C.drop_containing(table(spark, sf_dir, "lineitem"), ["date", "price", "disc", "line"])


@query("numeric_columns", """SELECT l_discount, l_extendedprice, l_linenumber, l_orderkey, l_partkey, l_quantity,
l_suppkey, l_tax FROM lineitem""")
def _(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.select(*C.numeric_columns(lineitem))


def _holed_events(spark, sf_dir):
    """events with missing values: no given number column has any."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", F.when(F.col("value") > 5, F.col("value")).alias("value"),
        F.when(F.col("event_type") == "click", F.lit(float("nan"))).otherwise(F.col("value")).alias("value2"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"))


HOLED = """(SELECT event_id, user_id, CASE WHEN value>5 THEN value END AS value,
CASE WHEN event_type='click' THEN 'nan'::DOUBLE ELSE value END AS value2,
CASE WHEN event_type<>'view' THEN event_type END AS kind FROM events)"""


@query("drop_null_columns", f"SELECT event_id, user_id, kind FROM {HOLED}")
def _(spark, sf_dir):
    return C.drop_null_columns(_holed_events(spark, sf_dir))


@query("null_ratios", f"""SELECT round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END),6) AS value,
round(avg(CASE WHEN isnan(value2) THEN 1.0 ELSE 0 END),6) AS value2, round(avg(CASE WHEN kind IS NULL THEN 1.0 ELSE 0 END),6)
AS kind FROM {HOLED}""")
def _(spark, sf_dir):
    return rounded(C.null_ratios(_holed_events(spark, sf_dir), ["value", "value2", "kind"]))


@query("drop_null_rows", f"""SELECT * FROM {HOLED} WHERE value IS NOT NULL AND NOT isnan(value2) AND kind IS NOT NULL""")
def _(spark, sf_dir):
    return _holed_events(spark, sf_dir).na.drop("any")


@query("fill_missing", f"""SELECT event_id, coalesce(value,0.0) AS value,
CASE WHEN isnan(value2) THEN 0.0 ELSE value2 END AS value2 FROM {HOLED}""")
def _(spark, sf_dir):
    return C.fill_missing(_holed_events(spark, sf_dir).select("event_id", "value", "value2"), ["value", "value2"])


@query("drop_missing_in_statistic", f"""SELECT count(*) AS n, round(avg(value2),6) AS mean FROM {HOLED}
WHERE value2 IS NOT NULL AND NOT isnan(value2)""")
def _(spark, sf_dir):
    from analystry.operators.ordering import is_number
    kept = _holed_events(spark, sf_dir).where(is_number(F.col("value2")))
    return rounded(kept.agg(F.count(F.lit(1)).alias("n"), F.avg("value2").alias("mean")))


@query("cast_with_rejects", """SELECT p_partkey, TRY_CAST(regexp_replace(p_brand,'[^0-9]','','g') AS INTEGER) AS code,
CAST(p_size AS FLOAT) AS size FROM part WHERE TRY_CAST(regexp_replace(p_brand,'[^0-9]','','g') AS INTEGER) IS NOT NULL""")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.regexp_replace("p_brand", r"\D", "").alias("code"), F.col("p_size").cast("string").alias("size"))
    return C.cast_with_rejects(part, {"code": "int", "size": "float"})[0]


@query("profile_events", """
SELECT 'event_id' AS "column", 'bigint' AS type, count(*) AS rows, count(event_id) AS non_null FROM events UNION ALL
SELECT 'ts', 'timestamp_ntz', count(*), count(ts) FROM events UNION ALL
SELECT 'user_id', 'bigint', count(*), count(user_id) FROM events UNION ALL
SELECT 'event_type', 'string', count(*), count(event_type) FROM events UNION ALL
SELECT 'value', 'double', count(*), count(value) FROM events UNION ALL
SELECT 'props', 'string', count(*), count(props) FROM events""")
def _(spark, sf_dir):
    return C.profile(table(spark, sf_dir, "events"))


# ---- filters and labels ----------------------------------------------------------------------

@query("equal_filter", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")


@query("not_equal_filter", f"SELECT event_id, kind FROM {HOLED} WHERE kind IS DISTINCT FROM 'error'")
def _(spark, sf_dir):
    return C.not_equal(_holed_events(spark, sf_dir).select("event_id", "kind"), "kind", "error")


@query("category_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('en','fr')")
def _(spark, sf_dir):
    return C.in_categories(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["en", "fr"])


@query("quadrant_filter", """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
WHERE l_quantity >= 25 AND l_discount >= 0.05""")
def _(spark, sf_dir):
    colour = N.quadrant(F.col("l_quantity"), F.col("l_discount"), F.lit(25.0), F.lit(0.05))
    kept = table(spark, sf_dir, "lineitem").where(colour == "red")
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("quadrant_counts", """SELECT CASE WHEN l_quantity<25 THEN CASE WHEN l_discount<0.05 THEN 'gray' ELSE 'green' END
ELSE CASE WHEN l_discount<0.05 THEN 'orange' ELSE 'red' END END AS colour, count(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, sf_dir):
    colour = N.quadrant(F.col("l_quantity"), F.col("l_discount"), F.lit(25.0), F.lit(0.05))
    return table(spark, sf_dir, "lineitem").groupBy(colour.alias("colour")).agg(F.count(F.lit(1)).alias("n"))


@query("one_vs_rest_label", "SELECT vec_id, label = 3 AS y FROM embeddings")
def _(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") == 3).alias("y"))


@query("feature_mask", """SELECT vec_id, embedding[1]::DOUBLE AS f0, embedding[3]::DOUBLE AS f2,
embedding[5]::DOUBLE AS f4 FROM embeddings""")
def _(spark, sf_dir):
    from pyspark.ml.feature import VectorSlicer
    from pyspark.ml.functions import array_to_vector, vector_to_array
    df = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("v"))
    sliced = VectorSlicer(inputCol="v", outputCol="s", indices=[0, 2, 4]).transform(df)
    values = vector_to_array("s")
    return sliced.select("vec_id", values[0].alias("f0"), values[1].alias("f2"), values[2].alias("f4"))


@query("vector_to_dense", "SELECT vec_id, len(embedding) AS size, embedding[64]::DOUBLE AS last FROM embeddings")
def _(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    df = table(spark, sf_dir, "embeddings").select("vec_id", vector_to_array(array_to_vector("embedding")).alias("a"))
    return df.select("vec_id", F.size("a").cast("long").alias("size"), F.element_at("a", -1).alias("last"))


# ---- scalar functions ------------------------------------------------------------------------

@query("strip_and_unknown", r"""SELECT event_id, regexp_replace('  '||event_type||chr(9)||' ','^\s+|\s+$','','g') AS kind,
CASE WHEN length(CAST(user_id AS VARCHAR))<2 THEN 'unknown' ELSE CAST(user_id AS VARCHAR) END AS genre FROM events""")
def _(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.col("event_type"), F.lit("\t "))
    return table(spark, sf_dir, "events").select(
        "event_id", T.strip_spaces(padded).alias("kind"),
        T.unknown_if_short(F.col("user_id").cast("string")).alias("genre"))


@query("first_number", """SELECT event_id, TRY_CAST(regexp_replace(props,'[^0-9]','','g') AS DOUBLE) AS shows FROM events""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.first_number(F.array("props", "event_type")).alias("shows"))


@query("drop_long_spaces", r"""SELECT doc_id, md5(regexp_replace(replace(text,' ','  '),'\s{2,}','','g')) AS h FROM documents""")
def _(spark, sf_dir):
    doubled = F.replace("text", F.lit(" "), F.lit("  "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.drop_long_spaces(doubled)).alias("h"))


@query("between_markers", """SELECT page_id, CASE WHEN position('<title>' IN html)>0 THEN
split_part(substr(html, position('<title>' IN html)+7), '</title>', 1) END AS title FROM pages""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", T.between_markers(F.col("html"), "<title>", "</title>").alias("title"))


@query("drop_class_attribute", r"""SELECT page_id, md5(regexp_replace(html,'\s*class="[\w\s]+"\s*','','g')) AS h FROM pages""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.drop_class_attribute(F.col("html"))).alias("h"))


@query("brazilian_number", """SELECT c_custkey, c_acctbal AS v FROM customer""")
def _(spark, sf_dir):
    written = F.translate(F.format_number("c_acctbal", 2), ",.", ".,")
    return table(spark, sf_dir, "customer").select("c_custkey", T.brazilian_number(written).cast("double").alias("v"))


#: References that the pages hold, for the SQL; the function knows all of the standard.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&nbsp;": "\xa0", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def _unescape_sql(column):
    for name, sign in ENTITIES.items():
        column = "replace({}, '{}', '{}')".format(column, name, sign.replace("'", "''"))
    return column


@query("html_unescape", f"SELECT page_id, md5({_unescape_sql('html')}) AS h FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_unescape(F.col("html"))).alias("h"))


@query("obfuscate_words", f"""SELECT doc_id, md5(regexp_replace(text,'({W}{{0,2}}){W}+({W}{{1,3}})','\\1XX\\2','g')) AS h
FROM documents""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.obfuscate_words(F.col("text"))).alias("h"))


@query("mask_word_characters", f"SELECT doc_id, md5(regexp_replace(text,'{W}','x','g')) AS h FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.mask_word_characters(F.col("text"))).alias("h"))


@query("char_ngrams", """
WITH c AS (SELECT doc_id, unnest(string_split(text,'')) AS a, generate_subscripts(string_split(text,''),1) AS i FROM documents),
l AS (SELECT a, lead(a,1) OVER w AS b, lead(a,2) OVER w AS c FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT a||b AS gram FROM l WHERE c IS NOT NULL UNION ALL SELECT a||b||c FROM l WHERE c IS NOT NULL)
SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def _(spark, sf_dir):
    grams = F.explode(T.char_ngrams(F.col("text"), 2, 3)).alias("gram")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select(grams).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("char_ngrams_of_lists", """
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)),1) AS k FROM documents),
c AS (SELECT doc_id, k, unnest(string_split(line,'')) AS a, generate_subscripts(string_split(line,''),1) AS i FROM s),
g AS (SELECT doc_id, a||lead(a,1) OVER w||lead(a,2) OVER w AS gram FROM c WINDOW w AS (PARTITION BY doc_id, k ORDER BY i))
SELECT doc_id, count(*) AS n, sum(CASE WHEN gram IN ('the','que','der','los') THEN 1 ELSE 0 END)::BIGINT AS known
FROM g WHERE gram IS NOT NULL GROUP BY doc_id""")
def _(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    lines = docs.select("doc_id", F.split("text", "\n").alias("lines"))
    grams = lines.select("doc_id", F.flatten(F.transform("lines", lambda s: T.char_ngrams(s, 3, 3))).alias("g"))
    known = T.keep_vocabulary(F.col("g"), ["the", "que", "der", "los"])
    counted = grams.select("doc_id", F.size("g").cast("long").alias("n"), F.size(known).cast("long").alias("known"))
    return counted.where(F.col("n") > 0)


@query("edit_distance", """SELECT a.n_name AS a, levenshtein(a.n_name, r.r_name)::INTEGER AS d, r.r_name AS b
FROM nation a JOIN region r ON a.n_regionkey = r.r_regionkey""")
def _(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("n_name").alias("a"), F.levenshtein("n_name", "r_name").alias("d"), F.col("r_name").alias("b"))


@query("url_parts", r"""SELECT page_id, regexp_extract(url,'^[a-z]+://[^/?#]*([^?#]*)',1) AS path,
regexp_extract(regexp_extract(url,'^[a-z]+://[^/?#]*([^?#]*)',1),'[^/]+$') AS file FROM pages""")
def _(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.url_path(u).alias("path"), T.url_file(u).alias("file"))


@query("date_parts", """SELECT event_id, substr(CAST(ts AS VARCHAR),1,4) AS year, substr(CAST(ts AS VARCHAR),6,2) AS month,
substr(CAST(ts AS VARCHAR),9,2) AS day, year(ts)::INTEGER AS y FROM events""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", *T.date_parts(F.col("ts").cast("string")), F.year("ts").alias("y"))


@query("has_key", """SELECT event_id, props->>'k' IS NOT NULL AS has_k, CAST(props->>'k' AS BIGINT) AS k,
props->>'z' IS NOT NULL AS has_z FROM events""")
def _(spark, sf_dir):
    parsed = F.from_json("props", "k long, z string")
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("p")).select(
        "event_id", F.col("p.k").isNotNull().alias("has_k"), F.col("p.k").alias("k"), F.col("p.z").isNotNull().alias("has_z"))


@query("paths_and_templates", """SELECT event_id, 'out/'||strftime(ts,'%Y')||'/'||event_type AS path,
'http://user'||user_id||'.example.com/api' AS url,
format('{:02d}m and {:02d}s', (CAST(round(value) AS BIGINT)//60), (CAST(round(value) AS BIGINT)%60)) AS took,
printf('%.0f%%', (k*100)::DOUBLE) AS pct
FROM (SELECT *, CAST(props->>'k' AS BIGINT) AS k FROM events)""")
def _(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat_ws("/", F.lit("out"), F.date_format("ts", "yyyy"), F.col("event_type")).alias("path"),
        F.format_string("http://user%d.example.com/api", F.col("user_id")).alias("url"),
        T.minutes_seconds(F.col("value")).alias("took"), T.percent_label(k).alias("pct"))


@query("lower_and_trim_text", """SELECT doc_id, md5(lower(text)) AS low, CASE WHEN length(text)>80 THEN
substr(text,1,77)||'...' ELSE text END AS short, octet_length(encode(text))::BIGINT AS bytes FROM documents""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(F.lower("text")).alias("low"), T.trim_to(F.col("text")).alias("short"),
        F.octet_length("text").cast("long").alias("bytes"))


@query("split_and_join_words", r"""SELECT doc_id, len(w)::BIGINT AS words, array_to_string(w[1:10],' ') AS head
FROM (SELECT doc_id, string_split(text,' ') AS w FROM documents)""")
def _(spark, sf_dir):
    words = F.split("text", " ")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(words).cast("long").alias("words"), F.array_join(F.slice(words, 1, 10), " ").alias("head"))


@query("arithmetic_functions", """SELECT event_id, round(ln(value+1),6) AS l, abs(value-10) AS a, ceil(value)::BIGINT AS c,
greatest(value,1.0) AS g, round_even(value,0) AS r, round(sqrt(value),6) AS s, round(power(value*user_id,0.5),6) AS gm,
1-(CASE WHEN event_type='click' THEN 1 ELSE 0 END) AS noty FROM events""")
def _(spark, sf_dir):
    v = F.col("value")
    out = table(spark, sf_dir, "events").select(
        "event_id", F.ln(v + 1).alias("l"), F.abs(v - 10).alias("a"), F.ceil(v).alias("c"),
        F.greatest(v, F.lit(1.0)).alias("g"), F.bround(v, 0).alias("r"), F.sqrt(v).alias("s"),
        N.geometric_mean([v, F.col("user_id")]).alias("gm"), (1 - (F.col("event_type") == "click").cast("int")).alias("noty"))
    return out.withColumns({c: F.round(c, 6) for c in ("l", "s", "gm")})


@query("strip_message", r"""
WITH m AS (SELECT doc_id, 'From: src'||chr(10)||'Subject: x'||chr(10)||chr(10)||'In article 5'||chr(10)||text||chr(10)
   ||'> quoted'||chr(10)||'--'||chr(10)||'bye' AS t FROM documents),
h AS (SELECT doc_id, substr(t, position(chr(10)||chr(10) IN t)+2) AS t FROM m),
f AS (SELECT doc_id, string_split(regexp_replace(t,'^\s+|\s+$','','g'), chr(10)) AS l FROM h),
k AS (SELECT doc_id, l[1:list_max(list_transform(range(1,len(l)+1), lambda i: CASE WHEN regexp_matches(l[i],'^\s*-*\s*$')
      THEN i-1 ELSE 0 END))] AS l FROM f)
SELECT doc_id, md5(array_to_string(list_filter(l, lambda x: NOT regexp_matches(x,
  '^[>|]|(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from)')), chr(10))) AS h FROM k""")
def _(spark, sf_dir):
    message = F.concat(F.lit("From: src\nSubject: x\n\nIn article 5\n"), F.col("text"), F.lit("\n> quoted\n--\nbye"))
    docs = table(spark, sf_dir, "documents").select("doc_id", message.alias("m"))
    return docs.select("doc_id", F.md5(T.strip_message(F.col("m"))).alias("h"))


# ---- unions ----------------------------------------------------------------------------------

@query("union_of_sources", """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, 'customer' AS kind FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'supplier' FROM supplier""")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return C.with_constants(c, kind="customer").unionByName(C.with_constants(s, kind="supplier"))


@query("vocabulary_membership", """
WITH t AS (SELECT doc_id, unnest(string_split(text,' ')) AS word FROM documents),
v AS (SELECT DISTINCT unnest(string_split(text,' ')) AS word FROM benchmark)
SELECT doc_id, count(*) AS n FROM t WHERE word IN (SELECT word FROM v) GROUP BY doc_id""")
def _(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    vocabulary = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    # counting per (document, word) first leaves one row per pair for the join
    counted = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("c"))
    return counted.join(vocabulary, "word", "left_semi").groupBy("doc_id").agg(F.sum("c").alias("n"))


# ---- plain aggregates, sorts, limits ----------------------------------------------------------

@query("group_sum", """SELECT c_mktsegment AS genre, round(sum(o_totalprice),2) AS total FROM orders JOIN customer
ON o_custkey=c_custkey GROUP BY 1""")
def _(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    # orders are summed per customer before the join, so a customer with very many orders is one row
    per_customer = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    joined = per_customer.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("genre")).agg(F.round(F.sum("t"), 2).alias("total"))


@query("pivot_count", """SELECT l_returnflag, count(*) FILTER (l_linestatus='F') AS F, count(*) FILTER (l_linestatus='O') AS O
FROM lineitem GROUP BY 1""")
def _(spark, sf_dir):
    pivoted = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"])
    return pivoted.agg(F.count(F.lit(1))).na.fill(0)


@query("pivot_mean", """SELECT event_type, round(avg(value) FILTER (user_id%3=0),6) AS u0,
round(avg(value) FILTER (user_id%3=1),6) AS u1, round(avg(value) FILTER (user_id%3=2),6) AS u2 FROM events GROUP BY 1""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("u", F.concat(F.lit("u"), F.col("user_id") % 3))
    return rounded(e.groupBy("event_type").pivot("u", ["u0", "u1", "u2"]).agg(F.avg("value")))


@query("distinct_values", "SELECT DISTINCT o_orderpriority FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderpriority").distinct()


@query("corpus_size", """SELECT count(*) AS documents, count(DISTINCT lang) AS categories,
round(sum(octet_length(encode(text)))/1e6,6) AS mb FROM documents""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("lang").alias("categories"),
        F.round(F.sum(F.octet_length("text")) / 1e6, 6).alias("mb"))


@query("top_customers", """SELECT c_name, round(sum(o_totalprice),2) AS total FROM orders JOIN customer ON o_custkey=c_custkey
GROUP BY c_custkey, c_name ORDER BY total DESC, c_name LIMIT 50""")
def _(spark, sf_dir):
    from analystry.plans.songs import top_by_total
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    totals = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    named = totals.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return top_by_total(named, "c_name", "t", 50)


@query("top_red_rows", """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity>=25 AND l_discount>=0.05
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 5""")
def _(spark, sf_dir):
    colour = N.quadrant(F.col("l_quantity"), F.col("l_discount"), F.lit(25.0), F.lit(0.05))
    kept = table(spark, sf_dir, "lineitem").where(colour == "red").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return kept.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(5)


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy("o_orderkey").limit(5)


@query("song_totals", """SELECT artist, round(sum(shows),6) AS shows FROM (
 SELECT 'u'||user_id AS artist, CASE WHEN length(event_type)<5 THEN 'unknown' ELSE event_type END AS genre,
 TRY_CAST(regexp_replace(props,'[^0-9]','','g') AS DOUBLE) AS shows FROM events)
WHERE genre IS DISTINCT FROM 'click' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40""")
def _(spark, sf_dir):
    from analystry.plans.songs import clean_songs, top_by_total
    songs = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("artist"), F.col("event_type").alias("genre"),
        F.col("event_type").alias("contributor"), F.array("props").alias("exbibitions"))
    cleaned = clean_songs(songs, short_genre=5)
    return top_by_total(C.not_equal(cleaned, "genre", "click"), "artist", "exbibitions", 40, total="shows", places=6)
