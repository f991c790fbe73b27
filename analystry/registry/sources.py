"""Round trips through the file formats, page parsing, grids and fixed tables."""

import math

from pyspark.sql import functions as F

from analystry.functions import text as T
from analystry.operators.quantiles import scalars
from analystry.plans import archive as A
from analystry.plans import city_table as C
from analystry.registry.book import query, rounded
from analystry.session import scratch_path, table
from analystry.sources import dimensions as D
from analystry.sources import files as S
from analystry.sources import generated as G

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("delimited_semicolon", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf_dir):
    path = scratch_path(spark, "semicolon")
    S.write_delimited(table(spark, sf_dir, "customer"), path, ";")
    return S.read_delimited(spark, path, ";", CUSTOMER)


@query("delimited_pipe", "SELECT doc_id, md5(text) AS h, lang FROM documents")
def _(spark, sf_dir):
    path = scratch_path(spark, "pipe")
    # hex keeps line ends and quotes of free text out of the delimited file
    S.write_delimited(table(spark, sf_dir, "documents").select("doc_id", F.hex(F.encode("text", "UTF-8")).alias("t"), "lang"), path)
    back = S.read_delimited(spark, path, "|", "doc_id long, t string, lang string")
    return back.select("doc_id", F.md5(F.decode(F.unhex("t"), "UTF-8")).alias("h"), "lang")


@query("json_array_files", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf_dir):
    path = scratch_path(spark, "arrays")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    S.write_json_arrays(orders, path, F.floor(F.col("o_orderkey") / 500))
    return S.read_json_arrays(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


@query("nested_json_header", "SELECT s_nationkey AS problem, 'unknown'||s_nationkey AS unknown_folder, s_name AS author FROM supplier")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "supplier")
    block = F.floor(F.col("s_suppkey") / 50)
    grouped = n.groupBy("s_nationkey", block).agg(F.collect_list(F.struct(F.col("s_name").alias("author-name"))).alias("a"))
    header = grouped.select(F.col("s_nationkey").alias("problem"), F.to_json(F.struct(
        F.concat(F.lit("unknown"), "s_nationkey").alias("unknown-folder"), F.col("a").alias("candidate-authors"))).alias("j"))
    return S.parse_problem_header(header, "j", ["problem"])


@query("labelled_text_files", "SELECT lang AS problem, source AS label, md5(text) AS h, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, sf_dir):
    path = scratch_path(spark, "texts")
    S.write_labelled_texts(table(spark, sf_dir, "documents"), path, ["lang", "source"])
    back = S.read_labelled_texts(spark, path)
    # the writer ends each file with one line end
    return back.groupBy("problem", "label", F.md5(F.regexp_replace("text", r"\n\z", "")).alias("h")).agg(F.count(F.lit(1)).alias("n"))


@query("sentence_lines", r"""WITH l AS (SELECT trim(unnest(string_split(text,chr(10)))) AS line FROM documents),
w AS (SELECT unnest(regexp_split_to_array(line,'\s+')) AS word FROM l WHERE line<>'')
SELECT word, count(*) AS n FROM w GROUP BY word""")
def _(spark, sf_dir):
    path = scratch_path(spark, "lines")
    table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    return S.read_sentences(spark, path).select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("decode_pages", "SELECT page_id, md5(html) AS h FROM pages")
def _(spark, sf_dir):
    path = scratch_path(spark, "bytes")
    html = F.col("html")
    # pages that Latin-1 can hold are stored in it when their number is odd
    latin = (F.col("page_id") % 2 == 1) & ~html.rlike("[^\\x00-\\xFF]")
    stored = F.when(latin, F.encode(F.regexp_replace(html, "[^\\x00-\\xFF]", "?"), "ISO-8859-1")).otherwise(F.encode(html, "UTF-8"))
    table(spark, sf_dir, "pages").select("page_id", stored.alias("content")).write.parquet(path)
    back = spark.read.schema("page_id long, content binary").parquet(path)
    return back.select("page_id", F.md5(S.decode_page(F.col("content"))).alias("h"))


@query("answers_sink", "SELECT lang AS problem, doc_id||'.txt' AS unknown_text, source AS predicted_author FROM documents")
def _(spark, sf_dir):
    path = scratch_path(spark, "answers")
    S.write_answers(table(spark, sf_dir, "documents").select(
        F.col("lang").alias("problem"), F.concat("doc_id", F.lit(".txt")).alias("unknown-text"),
        F.col("source").alias("predicted-author")), path)
    return S.read_answers(spark, path).toDF("unknown_text", "predicted_author", "problem")


@query("split_by_key", """SELECT event_id, CASE WHEN event_id%100<33 THEN 'test' ELSE 'train' END AS subset FROM events""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    parts = [S.load_labelled(e, "event_id", s, 33, modulo=True).withColumn("subset", F.lit(s)) for s in ("train", "test")]
    return parts[0].unionByName(parts[1])


def _digits(seed: int) -> str:
    """Ten hexadecimal digits of md5('<event_id>:<seed>') as a number."""
    return f"CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':{seed}'), 1, 10) AS BIGINT)"


@query("split_by_hash", f"""SELECT event_id, CASE WHEN {_digits(42)} % 100 < 40 THEN 'test' ELSE 'train' END AS subset FROM events""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    parts = [S.load_labelled(e, "event_id", s, 40, seed=42).withColumn("subset", F.lit(s)) for s in ("train", "test")]
    return parts[0].unionByName(parts[1])


@query("labelled_documents", "SELECT doc_id, quality, lang FROM documents JOIN labels USING (doc_id) WHERE doc_id%100>=33")
def _(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return S.load_labelled(both.select("doc_id", "quality", "lang"), "doc_id", "train", 33, modulo=True)


@query("state_lookup", "WITH s(position, state, region) AS (VALUES " + ",".join(
    f"({i},'{s}','{r}')" for i, (s, r) in enumerate(D.STATES)) +
    ") SELECT state, region, count(*) AS n FROM events JOIN s ON user_id%26=position GROUP BY 1,2")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 26).cast("int").alias("position")).agg(F.count(F.lit(1)).alias("n"))
    return e.join(F.broadcast(D.states(spark)), "position").select("state", "region", "n")


@query("measure_lookup", "WITH m(position, a, b, r) AS (VALUES " + ",".join(
    f"({5 * i + j},'{a}','{b}',{D.MEASURE_CORRELATION[i][j]}::DOUBLE)" for i, a in enumerate(D.MEASURES) for j, b in enumerate(D.MEASURES)) +
    ") SELECT a, b, r, printf('%.0f%%', r*100) AS percent, count(*) AS n FROM events JOIN m ON user_id%25=position GROUP BY ALL")
def _(spark, sf_dir):
    from analystry.functions.text import percent_label
    order = F.array(*[F.lit(x) for x in D.MEASURES])
    position = (F.array_position(order, F.col("a")) - 1) * len(D.MEASURES) + F.array_position(order, F.col("b")) - 1
    measures = D.measure_correlation(spark).withColumn("position", position.cast("int"))
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 25).cast("int").alias("position")).agg(F.count(F.lit(1)).alias("n"))
    return e.join(F.broadcast(measures), "position").select("a", "b", "r", percent_label(F.col("r")).alias("percent"), "n")


@query("note_lookup", "WITH s(position, name, freq) AS (VALUES " + ",".join(
    f"({i},'{n}',{f!r}::DOUBLE)" for i, n, f in D.note_frequencies()) +
    ") SELECT event_id, name, freq FROM events JOIN s ON (event_id+30)%108=position")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") + 30) % 108).cast("int").alias("position"))
    return e.join(F.broadcast(D.notes(spark)), "position").select("event_id", "name", "freq")


@query("grid_over_extent", """WITH l AS (SELECT min(l_quantity) a, max(l_quantity) b, min(l_discount) c, max(l_discount) d FROM lineitem)
SELECT (i*15+j)::BIGINT AS cell, i::INTEGER AS i, j::INTEGER AS j, round(a-(b-a)*0.05+i*(b-a)*1.1/14,6) AS x, round(c-(d-c)*0.05+j*(d-c)*1.1/14,6) AS y
FROM l, generate_series(0,14) p(i), generate_series(0,14) q(j)""")
def _(spark, sf_dir):
    return rounded(G.grid2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", 15))


@query("mesh_over_extent", """WITH l AS (SELECT min(l_discount)-0.5::DOUBLE a, max(l_discount)+0.5::DOUBLE b, min(l_tax)-0.5::DOUBLE c, max(l_tax)+0.5::DOUBLE d FROM lineitem)
SELECT round(a+i*0.02::DOUBLE,6) AS x, round(c+j*0.02::DOUBLE,6) AS y FROM l, generate_series(0,999) p(i), generate_series(0,999) q(j)
WHERE i < ceil((b-a)/0.02::DOUBLE) AND j < ceil((d-c)/0.02::DOUBLE)""")
def _(spark, sf_dir):
    return rounded(G.mesh(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", 0.02))


@query("moons_over_rows", f"""WITH i AS (SELECT event_id, row_number() OVER (ORDER BY event_id)-1 AS k, count(*) OVER () AS n FROM events),
s AS (SELECT event_id, k<n//2 AS o, CASE WHEN k<n//2 THEN k/greatest(n//2-1,1)::DOUBLE ELSE (k-n//2)/greatest(n-n//2-1,1)::DOUBLE END*{math.pi!r} AS t FROM i)
SELECT event_id, round(CASE WHEN o THEN cos(t) ELSE 1-cos(t) END,6)+0.0 AS x, round(CASE WHEN o THEN sin(t) ELSE 0.5-sin(t) END,6)+0.0 AS y,
CASE WHEN o THEN 0 ELSE 1 END AS label FROM s""")
def _(spark, sf_dir):
    return rounded(G.moons(table(spark, sf_dir, "events"), "event_id"))


@query("circles_over_rows", f"""WITH i AS (SELECT event_id, row_number() OVER (ORDER BY event_id)-1 AS k, count(*) OVER () AS n FROM events),
s AS (SELECT event_id, k<n//2 AS o, CASE WHEN k<n//2 THEN k/(n//2)::DOUBLE ELSE (k-n//2)/(n-n//2)::DOUBLE END*2*{math.pi!r} AS t FROM i)
SELECT event_id, round(CASE WHEN o THEN 1 ELSE 0.5 END*cos(t),6)+0.0 AS x, round(CASE WHEN o THEN 1 ELSE 0.5 END*sin(t),6)+0.0 AS y,
CASE WHEN o THEN 0 ELSE 1 END AS label FROM s""")
def _(spark, sf_dir):
    return rounded(G.circles(table(spark, sf_dir, "events"), "event_id"))


def _share(seed: int) -> str:
    return f"(({_digits(seed)} + 0.5::DOUBLE) / 1099511627776.0::DOUBLE)"


@query("blobs_over_rows", f"""SELECT event_id, {', '.join(
    f"round((CASE WHEN {_share(0)} < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) + sqrt(-2*ln({_share(1)})) * {turn}(2*pi()*{_share(2)}) + 2.0::DOUBLE * {_share(seed)}, 6) AS {name}"
    for name, turn, seed in (('x', 'cos', 3), ('y', 'sin', 4)))},
CASE WHEN {_share(0)} < 0.5 THEN 0 ELSE 1 END AS label FROM events""")
def _(spark, sf_dir):
    return rounded(G.blobs(table(spark, sf_dir, "events"), "event_id", shift=2.0))


@query("echo_series", f"""WITH b AS (SELECT event_id, CASE WHEN {_share(0)} < 0.5 THEN 0 ELSE 1 END AS x FROM events)
SELECT event_id, x, coalesce(lag(x, 3) OVER (ORDER BY event_id), 0) AS y FROM b""")
def _(spark, sf_dir):
    return G.echo_series(table(spark, sf_dir, "events"), "event_id")


# ---- pages, posts, archive --------------------------------------------------------------------

def answer_pages(spark, sf_dir):
    """events as blog posts, 50 to a JSONP page."""
    e = table(spark, sf_dir, "events")
    url = lambda folder: F.concat(F.lit(f"http://img.example.com/{folder}/"), "event_id", F.lit(".jpg?x=1"))
    post = F.struct(
        F.concat(F.lit("post-"), "event_id").alias("slug"), F.when(F.col("event_type") == "click", "photo").otherwise("text").alias("type"),
        F.col("ts").cast("string").alias("date-gmt"), F.when(F.col("event_id") % 2 == 0, url("main")).alias("photo-url-1280"),
        F.array(F.struct(url("a/1").alias("photo-url-1280")), F.struct(F.concat(F.lit("http://img.example.com/b/"), "event_id", F.lit(".png")).alias("photo-url-1280"))).alias("photos"))
    total = e.agg(F.count(F.lit(1)).alias("n"))
    grouped = e.groupBy((F.floor(F.col("event_id") / 50) * 50).alias("start")).agg(F.collect_list(post).alias("posts"))
    body = F.to_json(F.struct(scalars(total)["n"].alias("posts-total"), "posts"))
    return grouped.select("start", F.concat(F.lit("  var blog_api_answer = "), body, F.lit(";\n")).alias("body"))


PHOTOS = """photos AS (
SELECT event_id, 'post-'||event_id AS slug, ts, 'http://img.example.com/main/'||event_id||'.jpg?x=1' AS url, event_id||'.jpg' AS file FROM events WHERE event_id%2=0
UNION ALL SELECT event_id, 'post-'||event_id, ts, 'http://img.example.com/a/1/'||event_id||'.jpg?x=1', event_id||'.jpg' FROM events WHERE event_type='click'
UNION ALL SELECT event_id, 'post-'||event_id, ts, 'http://img.example.com/b/'||event_id||'.png', event_id||'.png' FROM events WHERE event_type='click')"""


@query("jsonp_posts", """SELECT 'post-'||event_id AS slug, CASE WHEN event_type='click' THEN 'photo' ELSE 'text' END AS type,
substr(CAST(ts AS VARCHAR),1,10) AS posted FROM events""")
def _(spark, sf_dir):
    posts = A.posts_of(answer_pages(spark, sf_dir), "body")
    return posts.select("slug", "type", F.substring("`date-gmt`", 1, 10).alias("posted"))


@query("post_photos", f"""WITH {PHOTOS} SELECT strftime(ts,'%Y') AS year, strftime(ts,'%m') AS month, strftime(ts,'%d') AS day, slug, url, file FROM photos""")
def _(spark, sf_dir):
    return A.photos_of(A.posts_of(answer_pages(spark, sf_dir), "body")).drop("place")


@query("page_ranges", """SELECT unnest(generate_series(0, (SELECT count(*) FROM events)-1, 50)) AS start""")
def _(spark, sf_dir):
    return A.page_ranges(table(spark, sf_dir, "events"))


@query("missing_pages", """SELECT start FROM (SELECT unnest(generate_series(0, (SELECT count(*) FROM events)-1, 50)) AS start) WHERE start%350=0""")
def _(spark, sf_dir):
    pages = answer_pages(spark, sf_dir)
    return A.missing_pages(pages.where(F.col("start") % 350 != 0), "body", "start")


DAILY = """n AS (SELECT DISTINCT strftime(ts,'%Y') AS year, strftime(ts,'%m') AS month, strftime(ts,'%d') AS day, slug, file FROM photos {where})
SELECT year, month, day, count(DISTINCT slug) AS posts, count(*) AS photos FROM n GROUP BY 1,2,3"""


@query("archive_job", f"WITH {PHOTOS}, " + DAILY.format(where="WHERE event_id%10<>0"))
def _(spark, sf_dir):
    pages = answer_pages(spark, sf_dir)
    photos = A.photos_of(A.posts_of(pages, "body"))
    stored = photos.where(F.regexp_extract("slug", r"(\d+)$", 1).cast("long") % 10 == 0)
    return A.archive(pages, "body", scratch_path(spark, "archive"), stored)


@query("archive_one_month", f"WITH {PHOTOS} SELECT DISTINCT slug, file, strftime(ts,'%d') AS day FROM photos WHERE strftime(ts,'%Y-%m')='2024-01'")
def _(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    A.write_manifest(A.new_photos(A.photos_of(A.posts_of(answer_pages(spark, sf_dir), "body")), None), path)
    month = A.read_manifest(spark, path).where((F.col("year") == "2024") & (F.col("month") == "01"))
    return month.select("slug", "file", "day")


@query("archive_stream", f"WITH {PHOTOS}, " + DAILY.format(where=""))
def _(spark, sf_dir):
    from analystry.streaming.archive import archive_stream
    source = scratch_path(spark, "incoming")
    answer_pages(spark, sf_dir).select("body").write.option("maxRecordsPerFile", 1).text(source)
    found = archive_stream(spark, source, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state"))
    return found.groupBy("year", "month", "day").agg(F.countDistinct("slug").alias("posts"), F.count(F.lit(1)).alias("photos"))


# ---- HTML tables -------------------------------------------------------------------------------

def state_pages(spark, sf_dir):
    """customers written as HTML tables of at most 50 rows per nation."""
    brazilian = lambda c, d: F.translate(F.format_number(c, d), ",.", ".,")
    cells = [F.col("c_name"), F.col("c_custkey").cast("string"), F.col("c_mktsegment"), brazilian(F.col("c_custkey") * 1000, 0),
             brazilian(F.col("c_acctbal") * 2, 2), brazilian(F.col("c_acctbal") / 7, 2), brazilian(F.col("c_acctbal"), 2)]
    row = F.concat(F.lit('<tr class="r 1">'), *[F.concat(F.lit('<td class="c">'), c, F.lit("</td>")) for c in cells], F.lit("</tr>\n   "))
    grouped = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 50)).agg(F.collect_list(row).alias("r"))
    page = F.concat(F.lit('<html><table><thead><tr><th>x</th></tr></thead><tbody class="body">'), F.array_join("r", ""),
                    F.lit("<tr></tr></tbody></table></html>"))
    return grouped.select(F.concat(F.lit("s"), "c_nationkey").alias("state"), F.lit("norte").alias("region"), page.alias("content"))


@query("html_table_rows", """SELECT 's'||c_nationkey AS state, c_name AS cidade, CAST(c_custkey AS VARCHAR) AS "codigoIBGE", c_mktsegment AS gentilico FROM customer""")
def _(spark, sf_dir):
    return C.city_rows(state_pages(spark, sf_dir)).select("state", "cidade", "codigoIBGE", "gentilico")


@query("city_table", """SELECT c_name AS cidade, CAST(c_custkey AS VARCHAR) AS "codigoIBGE", c_mktsegment AS gentilico, (c_custkey*1000)::INTEGER AS populacao,
CAST(c_acctbal AS FLOAT) AS pib, 's'||c_nationkey AS state, 'norte' AS region FROM customer""")
def _(spark, sf_dir):
    path = scratch_path(spark, "cities")
    S.write_delimited(C.city_rows(state_pages(spark, sf_dir)), path)
    text_schema = ", ".join(f"{c} string" for c in [*C.CITY_COLUMNS, "state", "region"])
    from analystry.operators.columns import cast_with_rejects
    typed, _rejected = cast_with_rejects(S.read_delimited(spark, path, "|", text_schema), {"populacao": "int", "pib": "float"})
    return typed.drop("area", "densidadeDemografica")
