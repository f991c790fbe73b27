"""Secrets and the parts of credentials that belong together; DataFrame functions only.

Every pattern cuts a text into gaps and matches; running sums of their lengths give the places, so a text is read once and only
lengths travel. Strong matches (assigned secrets, access identifiers, long hexadecimal runs) are reported as they are. Weak candidates
(identifiers, short or oddly named secrets, endpoints) are reported only if a complementary part lies in the same scope, a paragraph,
and not more than REACH code points away. That is an interval join: parts meet in bins of REACH code points, each of which is one row
with the first and last place of every role, so a candidate meets at most three rows per end however many parts there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from analystry.session import scratch_path, spread

#: Code points between two parts of a credential, at most.
REACH = 400
#: A weak secret has that many characters at least, and a letter and a digit.
LEAST_WEAK = 6
LEAST_ASSIGNED = 12

BLANK_LINE = r"\n[ \t\r]*\n"


def any_case(words: str) -> str:
    """The pattern with each letter in either case, as classes that every engine reads alike."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_SIGN = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = "(" + any_case("password|passwd|secret|token|api_?key") + ")" + _SIGN + "([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
NAMED_IDENTIFIER = "(" + any_case("client_?id|access_?key_?id|account|username|user|login") + ")" + _SIGN + "([A-Za-z0-9@._+-]{4,})"
NAMED_SECRET = "(" + any_case("access_?key|private_?key|account_?key|passphrase|pass|pwd|credential|auth") + ")" + _SIGN + r"([^\x20\x09-\x0D\"',;<>]+)"
ENDPOINT = "(" + any_case("https?|jdbc:[a-z]+|postgresql|postgres|mysql|mongodb|redis|amqps?|sftp|ftp|ssh").replace("[Aa]-[Zz]", "A-Za-z") + r")://([^\x20\x09-\x0D\"'<>,;()]+)"

#: Kinds in the order of their places in results, with the pattern and the group whose text counts. The first three are always reported.
KINDS = (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("identifier", NAMED_IDENTIFIER, 2), ("secret", NAMED_SECRET, 2), ("endpoint", ENDPOINT, 0))
BASE = 3
ROLES = ("identifier", "secret", "endpoint")
#: Which roles complete which.
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}

_STEP = "struct<place:int,gap:int,long:int,value:int,breaks:int,mixed:boolean>"


def _steps(text: Column, place: int) -> Column:
    """An array of (place, gap before, length, length of the value, blank lines in the gap, letter and digit in the value) per match."""
    _, pattern, group = KINDS[place]

    def step(gap: Column, hit: Column) -> Column:
        value = F.regexp_extract(hit, pattern, group) if group else hit
        mixed = value.rlike("[A-Za-z]") & value.rlike("[0-9]")
        return F.when(hit.isNotNull(), F.struct(
            F.lit(place).alias("place"), F.length(gap).alias("gap"), F.length(hit).alias("long"), F.length(value).alias("value"),
            F.regexp_count(gap, F.lit(BLANK_LINE)).alias("breaks"), mixed.alias("mixed")))

    steps = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), step)
    found = F.filter(steps, lambda s: s.isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_STEP}>"))


def scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, steps) of every row of `docs`, written in the shared folder; `row` tells rows apart that share a doc_id."""
    rows = spread(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    path = scratch_path(docs.sparkSession, "secrets")
    steps = F.concat(*[_steps(F.col("text"), place) for place in range(len(KINDS))])
    rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", steps.alias("steps")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def placed_parts(scanned: DataFrame) -> DataFrame:
    """(row, doc_id, place, start, end, scope, role) of the matches that count; role is null for what completes nothing.

    Assignments too short for the first kind become weak secrets; weak parts that overlap a reported one are left out.
    """
    steps = scanned.select("row", "doc_id", F.posexplode("steps").alias("k", "step")).select("row", "doc_id", "k", "step.*")
    order = Window.partitionBy("row", "place").orderBy("k")
    at = steps.withColumns({
        "end": F.sum(F.col("gap") + F.col("long")).over(order), "scope": F.sum("breaks").over(order)}).withColumn("start", F.col("end") - F.col("long"))
    short = (F.col("place") == 0) & (F.col("value") < LEAST_ASSIGNED)
    weak_secret = (F.col("place") == 4) | short
    sound = ~weak_secret | F.col("mixed") & (F.col("value") >= LEAST_WEAK)
    role = (F.when(F.col("place").isin(0, 4), "secret").when((F.col("place") == 2) & F.col("mixed"), "secret")
            .when(F.col("place").isin(1, 3), "identifier").when(F.col("place") == 5, "endpoint"))
    parts = at.where(sound).select("row", "doc_id", F.when(short, 4).otherwise(F.col("place")).alias("place"), "start", "end", "scope", role.alias("role"))
    by_start = Window.partitionBy("row").orderBy("start", "place")
    base = F.col("place") < BASE
    before = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    beside = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("end"), F.lit(True))
    return parts.withColumn("beside", beside).where(base | F.col("beside")).drop("beside")


def linked(parts: DataFrame) -> DataFrame:
    """(row, doc_id, place, start, end) of the weak parts that a complementary part completes."""
    points = parts.where("role IS NOT NULL").withColumn("point", F.explode(F.array("start", F.col("end") - 1)))
    points = points.withColumn("bin", F.floor(F.col("point") / REACH))
    held = {r: F.when(F.col("role") == r, F.col("point")) for r in ROLES}
    bins = points.groupBy("row", "scope", "bin").agg(
        *[F.min(held[r]).alias(f"first_{r}") for r in ROLES], *[F.max(held[r]).alias(f"last_{r}") for r in ROLES])
    own = ["row", "doc_id", "place", "start", "end", "scope", "role", "point"]
    weak = points.where(F.col("place") >= BASE).select(*own, F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    # in the candidate's own bin and beside it, the part that is nearest is the first or the last of the bin
    near = {r: (F.abs(F.col(f"first_{r}") - F.col("point")) <= REACH) | (F.abs(F.col(f"last_{r}") - F.col("point")) <= REACH) for r in ROLES}
    completed = [(F.col("role") == r) & reduce(lambda a, b: a | b, [F.coalesce(near[o], F.lit(False)) for o in others]) for r, others in COMPLEMENTS.items()]
    met = weak.join(bins, ["row", "scope", "bin"]).where(reduce(lambda a, b: a | b, completed))
    return met.select("row", "doc_id", "place", "start", "end").distinct()


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added.

    The counts and base_sha256 are those of the strong matches; spans has these and the linked weak ones, by start and then kind, in
    code points, ends exclusive. Null and empty texts have none; rows that repeat are judged each, also without or with the same
    doc_id; texts of any length are read whole; other columns are not read; an empty table gives an empty result.
    """
    scanned = scan(docs)
    parts = placed_parts(scanned.where("size(steps) > 0"))
    weak = linked(parts)
    spans = parts.where(F.col("place") < BASE).select("row", "doc_id", "place", "start", "end").unionByName(weak)
    nothing = scanned.select("row", "doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("place", "int"), ("start", "long"), ("end", "long"))])
    loud = spans.unionByName(nothing.where("size(steps) > 0"))
    span = F.when(F.col("place").isNotNull(), F.struct("start", "place", "end"))
    found = loud.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans")).drop("row")
    quiet = scanned.where("size(steps) = 0").select("doc_id", F.array().cast("array<struct<start:bigint,place:int,end:bigint>>").alias("spans"))
    every = found.unionByName(quiet)
    name = F.array(*[F.lit(k) for k, _, _ in KINDS])
    base = F.filter("spans", lambda s: s["place"] < BASE)

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["place"]), s["start"], s["end"])), ",")

    def of_kind(place: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["place"] == place)).cast("long").alias(f"n_{KINDS[place][0]}")

    counts = [of_kind(place) for place in range(BASE)]
    return every.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
