"""The dealt operators as named queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from analystry.llm import bpe, minhash, mixing, passages, pii, quality, runs, secrets, topk, toxicity, urls, vectors, whitening
from analystry.session import table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def enter(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return enter


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """The installed vocabulary file of that name; it is there on every machine and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _like(glob: str) -> str:
    """A glob as a regular expression of the SQL engine."""
    out, k = "", 0
    while k < len(glob):
        if glob[k] == "*":
            double = glob[k:k + 2] == "**"
            out += "(.|\\n)*" if double else "[^/]*"
            k += 2 if double else 1
        else:
            out += "(.|\\n)" if glob[k] == "?" else "\\" + glob[k] if not glob[k].isalnum() else glob[k]
            k += 1
    return out


def _url_sql() -> str:
    rules = sorted(urls.SITE_RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in rules]
    names = " ".join(f"{f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, rules))
    verdicts = " ".join(f"{f} THEN '{v}'" for f, (_, _, v) in zip(fits, rules))
    globs = " ".join(f"WHEN regexp_full_match(host || path, '{_like(g)}') THEN '{g}'" for g in urls.BLOCK_GLOBS)
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
judged AS (SELECT *, CASE {names} END AS rule, CASE {verdicts} END AS ruled, CASE {globs} END AS matched_glob FROM parts)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN matched_glob IS NULL THEN 'allow' ELSE 'block' END) AS verdict, matched_glob FROM judged"""


@query("op1_url_filter", _url_sql())
def op1(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"))


MIX_SQL = f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
placed AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place, sum(source_size) OVER () AS total
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
weighed AS (SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], (place - 1) % 3 + 1) AS weight, 3.0::DOUBLE * source_size AS cap FROM placed),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level FROM weighed),
chosen AS (SELECT own_level AS level FROM levels WHERE weight * own_level <= cap ORDER BY cap / weight, place LIMIT 1),
targets AS (SELECT l.*, least(cap, weight * level) AS target FROM levels l, chosen),
shares AS (SELECT *, sum(target) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) / total AS high FROM targets),
block AS (SELECT greatest(1, least({mixing.SLOT_WORDS}, any_value(total) // {mixing.LEAST_SLOTS}))::BIGINT AS words, any_value(total)::BIGINT AS total FROM shares),
points AS (SELECT (i + 1) * {mixing.GOLDEN}::DOUBLE - floor((i + 1) * {mixing.GOLDEN}::DOUBLE) AS point
           FROM (SELECT unnest(range(((total + words - 1) // words)::BIGINT)) AS i FROM block)),
held AS (SELECT CASE WHEN place = (SELECT max(place) FROM shares WHERE target > 0) THEN 2.0 ELSE high END AS high, place FROM shares WHERE target > 0),
slots AS (SELECT place, count(*) AS n FROM points ASOF JOIN held ON point < high GROUP BY place),
laid AS (
  SELECT d.doc_id, d.size, s.place, s.source_size, s.target,
         sum(d.size) OVER (PARTITION BY s.place ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, CAST((
  SELECT sum(greatest(0, least(size, coalesce(n, 0) * words - pass * source_size - start))) FROM (SELECT unnest([0, 1, 2]) AS pass)) AS BIGINT) AS taken
FROM laid LEFT JOIN slots USING (place), block"""


@query("op7_source_mix", MIX_SQL)
def op7(spark, sf_dir):
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


@query("op3_bpe_tokens")
def op3(spark, sf_dir, vocabulary: str | None = None):
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary or tokenizer_file())


@query("op5_personal_data")
def op5(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query("op8_near_duplicates")
def op8(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


TOPK_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10"""


@query("op2_top_matches", TOPK_SQL)
def op2(spark, sf_dir):
    return topk.best_matches(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op4_toxicity")
def op4(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_quality")
def op6(spark, sf_dir):
    return quality.quality_posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_repeated_passages")
def op9(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


LINKS_SQL = """
WITH RECURSIVE rows AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, label IS NOT NULL AND embedding IS NOT NULL
         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM rows a JOIN rows b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.usable AND b.usable AND list_cosine_similarity(a.v, b.v) >= 0.93),
reached AS (SELECT vec_id AS node, vec_id AS other FROM rows UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a),
least AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM rows JOIN least ON node = vec_id LEFT JOIN counted ON a = vec_id"""


@query("op10_near_vectors", LINKS_SQL)
def op10(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op11_whitening")
def op11(spark, sf_dir):
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def _secrets_sql() -> str:
    hits = " UNION ALL ".join(
        f"""SELECT row, doc_id, {place} AS place, unnest(range(len(hits))) AS k, unnest(list_slice(gaps, 1, len(hits))) AS gap, unnest(hits) AS hit, unnest(vals) AS val FROM (
  SELECT row, doc_id, regexp_split_to_array(text, $p${pattern}$p$) AS gaps, regexp_extract_all(text, $p${pattern}$p$) AS hits, regexp_extract_all(text, $p${pattern}$p$, {group}) AS vals
  FROM texts WHERE regexp_matches(text, $p${pattern}$p$))""" for place, (_, pattern, group) in enumerate(secrets.KINDS))
    fits = " OR ".join(f"(w.role = '{r}' AND o.role IN ({', '.join(repr(x) for x in others)}))" for r, others in secrets.COMPLEMENTS.items())
    near = " OR ".join(f"abs(w.{a} - o.{b}) <= {secrets.REACH}" for a in ("first", "last") for b in ("first", "last"))
    names = ", ".join(repr(k) for k, _, _ in secrets.KINDS)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({hits}),
placed AS (
  SELECT row, doc_id, place, length(val) AS size, regexp_matches(val, '[A-Za-z]') AND regexp_matches(val, '[0-9]') AS mixed,
         sum(length(gap) + length(hit)) OVER w AS stop, sum(length(gap) + length(hit)) OVER w - length(hit) AS first, sum(len(regexp_extract_all(gap, '{secrets.BLANK_LINE}'))) OVER w AS scope
  FROM hits WINDOW w AS (PARTITION BY row, place ORDER BY k)),
parts AS (
  SELECT row, doc_id, CASE WHEN place = 0 AND size < {secrets.LEAST_ASSIGNED} THEN 4 ELSE place END AS place, first, stop, stop - 1 AS last, scope,
         CASE WHEN place IN (0, 4) OR place = 2 AND mixed THEN 'secret' WHEN place IN (1, 3) THEN 'identifier' WHEN place = 5 THEN 'endpoint' END AS role
  FROM placed WHERE NOT (place = 4 OR place = 0 AND size < {secrets.LEAST_ASSIGNED}) OR mixed AND size >= {secrets.LEAST_WEAK}),
beside AS (SELECT * FROM parts w WHERE place < {secrets.BASE} OR NOT EXISTS (SELECT 1 FROM parts b WHERE b.row = w.row AND b.place < {secrets.BASE} AND b.first < w.stop AND w.first < b.stop)),
kept AS (SELECT * FROM beside w WHERE place < {secrets.BASE} OR EXISTS (SELECT 1 FROM beside o WHERE o.row = w.row AND o.scope = w.scope AND ({fits}) AND ({near}))),
told AS (
  SELECT row, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex, count(*) FILTER (place >= {secrets.BASE}) AS n_added,
         string_agg(name || ':' || CAST(first AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY first, place, stop) FILTER (place < {secrets.BASE}) AS base,
         string_agg(name || ':' || CAST(first AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY first, place, stop) AS spans
  FROM (SELECT *, list_extract([{names}], place + 1) AS name FROM kept) GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0)::BIGINT AS n_added
FROM texts LEFT JOIN told USING (row)"""


@query("op12_secrets", _secrets_sql())
def op12(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def with_planted_runs(docs):
    """doc_id and text; in a tenth of the documents, by a hash of the id, the words from some place on repeat a stretch of the text."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn("g", F.floor(F.col("h") / 10))
    split = chosen.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    n, g = F.col("n"), F.col("g")
    split = split.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    places = F.sequence(F.lit(0), n - F.col("a") - 1)
    tail = F.transform(places, lambda i: F.get(F.col("words"), F.col("a") + i % F.col("p")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return split.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), planted).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    found = runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # runs come by start and period, so the first of the greatest exponent wins; exponents are compared as fractions
    greater = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), greater)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256")
