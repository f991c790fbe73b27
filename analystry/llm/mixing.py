"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

The mix is a row of slots of equal length. Slot i stands at the golden-ratio point frac((i + 1) * phi); the source whose share of the
unit interval holds the point fills the slot, so every stretch of the mix comes close to the target shares. The k-th slot of a
source takes the k-th block of that source's shuffled text, which is read again from its start when it ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from analystry.llm.lookups import small_side
from analystry.session import scratch_path

WEIGHTS = (5, 2, 1)
#: A source and each of its documents is used this often at most.
MOST_PASSES = 3
#: Words of a slot in large mixes; small mixes use shorter ones, so that there are LEAST_SLOTS or one per word.
SLOT_WORDS = 1024
LEAST_SLOTS = 1 << 16
GOLDEN = 0.6180339887498949
#: Documents of one source whose words one task adds up, on average, and slots that one task ranks.
BIN_ROWS = 2000
RANK_ROWS = 1 << 16
SHARE_CELLS = 1024


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size) rows, one per source, with `place`, `weight`, `target` and the interval [`low`, `high`) of shares.

    Weights repeat over the sources by code point, null last. Shares add up to all words; a target stops at `most` times its
    source, and the rest is shared again by weight. One row per source: the windows here are over sources, not documents.
    """
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    placed = (
        sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    )
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    level = (F.col("total") - F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    levels = placed.withColumn("own_level", level)
    fits = F.col("weight") * F.col("own_level") <= F.col("cap")
    targets = levels.withColumn("level", F.min_by(F.when(fits, F.col("own_level")), F.when(fits, F.struct(F.col("cap") / F.col("weight"), "place"))).over(every))
    targets = targets.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))))
    shares = targets.withColumn("high", F.coalesce(F.try_divide(F.sum("target").over(Window.orderBy("place")), F.col("total")), F.lit(0.0)))
    last = F.max(F.when(F.col("target") > 0, F.col("place"))).over(every)
    low = F.coalesce(F.lag("high").over(Window.orderBy("place")), F.lit(0.0))
    return shares.withColumn("low", low).withColumn("high", F.when(F.col("place") == last, F.lit(2.0)).otherwise(F.col("high"))).select(
        "source", "place", "source_size", "weight", "target", "low", "high")


def slot_schedule(spark, targets: DataFrame, slots: int) -> DataFrame:
    """(slot, place, rank): the source of each slot, and how many slots of that source came before.

    Points and shares meet in cells of the unit interval, one or a few shares each. Ranks are counted per range of slots and shifted by the ranges before, so that no source is ranked in one task.
    """
    point = (F.col("id") + 1) * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * SHARE_CELLS))
    reach = F.sequence(F.floor(F.col("low") * SHARE_CELLS), F.least(F.floor(F.col("high") * SHARE_CELLS), F.lit(SHARE_CELLS - 1).cast("long")))
    cells = targets.where("low < high AND low < 1").select("place", "low", "high", F.explode(reach).alias("cell"))
    sourced = points.join(cells, "cell").where("point >= low AND point < high").select("slot", "place")
    sourced = sourced.withColumn("stretch", F.floor(F.col("slot") / RANK_ROWS))
    counts = sourced.groupBy("place", "stretch").agg(F.count("*").alias("n"))
    before = counts.select("place", "stretch", (F.sum("n").over(Window.partitionBy("place").orderBy("stretch")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("place", "stretch").orderBy("slot"))
    return sourced.withColumn("inside", inside).join(before, ["place", "stretch"]).select(
        "slot", "place", (F.col("before") + F.col("inside") - 1).alias("rank"))


def laid_out(sized: DataFrame, digits: int) -> DataFrame:
    """(place, row columns, start): where each document begins in the shuffled words of its source.

    The order is that of md5(doc_id). Documents are added up in bins of that order and bins per source, so that a source with
    a third of all rows is still many small windows.
    """
    rows = sized.withColumn("draw", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("bin", F.substring("draw", 1, digits))
    bins = rows.groupBy("place", "bin").agg(F.sum("size").alias("words"))
    before = bins.select("place", "bin", (F.sum("words").over(Window.partitionBy("place").orderBy("bin")) - F.col("words")).alias("before"))
    order = Window.partitionBy("place", "bin").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0))).join(before, ["place", "bin"]).withColumn(
        "start", F.col("before") + F.col("inside")).drop("draw", "bin", "inside", "before")


def plan_mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES, label: str = "mix") -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(documents laid out, slots, targets, words of a slot) for a table with doc_id, text and source.

    Texts are read once: doc_id, source and size go to a table in the shared folder, and all further steps work on that.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, label)
    docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).write.parquet(path)
    sized = spark.read.parquet(path)
    goals = scratch_path(spark, f"{label}-targets")
    source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).coalesce(1).write.parquet(goals)
    targets = spark.read.parquet(goals)
    rows, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    slot_words = max(1, min(SLOT_WORDS, words // LEAST_SLOTS))
    digits = max(0, min(6, math.ceil(math.log(max(rows, 1) / BIN_ROWS, 16)))) if rows > BIN_ROWS else 0
    placed = sized.join(targets.select("source", "place", "source_size", "target"), sized["source"].eqNullSafe(targets["source"])).drop("source")
    slots = slot_schedule(spark, targets, -(-words // slot_words))
    return laid_out(placed, digits), slots, targets, slot_words


def mix_pieces(laid: DataFrame, slots: DataFrame, slot_words: int, most: int = MOST_PASSES) -> DataFrame:
    """Pieces of documents in slots: the document's row, pass, slot and the words [`begin`, `end`) of the document.

    A document meets the blocks that its words touch, in each pass; a block that has no slot is not taken. Documents
    without words have no piece. The join key (place, rank) is a block of `slot_words` words, so no key is large.
    """
    passes = laid.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    placed = passes.withColumn("at", F.col("pass") * F.col("source_size") + F.col("start"))
    touched = placed.withColumn("rank", F.explode(F.sequence(
        F.floor(F.col("at") / slot_words), F.floor((F.col("at") + F.col("size") - 1) / slot_words))))
    begin = F.greatest(F.col("rank") * slot_words - F.col("at"), F.lit(0))
    end = F.least((F.col("rank") + 1) * slot_words - F.col("at"), F.col("size"))
    return touched.join(slots, ["place", "rank"]).select(
        "slot", "place", "start", "doc_id", "size", "pass", begin.alias("begin"), end.alias("end"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target of its source, taken (words in the mix, repeats counted).

    Null sources are a source of their own, placed last; null or empty texts have size 0 and are never taken; rows that repeat
    a doc_id count each as documents; an empty table gives an empty result.
    """
    laid, slots, _, slot_words = plan_mix(docs, weights, most)
    pieces = mix_pieces(laid, slots, slot_words, most)
    used = pieces.groupBy("place", "start").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    filled = laid.where("size > 0").join(used, ["place", "start"], "left")
    columns = ["doc_id", "size", "source_size", "target"]
    return filled.select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).unionByName(
        laid.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def mixed_rows(docs: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """The documents of the mix with all their columns, each as often as the mix takes it.

    A document is there once for each pass that takes at least half of its words; of every source at most one pass of one
    document is rounded so for each block that the schedule leaves out. Rows of one doc_id share the words taken.
    """
    taken = mix_documents(docs, weights, most).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    often = taken.where("size > 0").select("doc_id", times.alias("times")).where("times > 0")
    # the columns travel as one, so that no name can clash
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = rows.join(small_side(often), F.col("id").eqNullSafe(F.col("doc_id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")
