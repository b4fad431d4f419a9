"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents lie in a hash-shuffled row, end to end, cut into blocks of equally
many words (the last may be shorter). Slots 0, 1, 2, ... of the mix are van der Corput
points, i.e. their bits reversed; a point falls into one of the cumulative weights'
intervals, which names its source. A slot's rank among its source's slots gives pass and
block: ranks run through the shuffled blocks, then through them again. Interval bounds are
whole slots, so each source gets its number of slots to within one, in any stretch of the
schedule near its share.

Running sums and ranks go over (source, range of the hash) and (source, stretch of slots)
first and over those ranges' totals second, so a source with a third of all rows is
computed by many tasks. Tables by source have a row for each source only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, one_of_each, plain_names

#: Weights by position of the source in code point order.
WEIGHTS = (1, 2, 3)
#: No document is taken more often.
MAX_REPEATS = 3
#: Slots that the whole mix has at least (blocks shrink to that end), largest block, blocks of a source at least.
SLOTS, MAX_BLOCK, MIN_BLOCKS = 1 << 17, 4096, 64
#: Bits of the hash range, and slots of a stretch, that one task orders.
_RANGE_BITS, _STRETCH = 12, 1 << 16
_CELLS = 1 << 10


def words_in(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source key, size, and two digests that name and shuffle the row."""
    rows = docs.select("doc_id", source_key().alias("src"), words_in().alias("size"), text_digest().alias("digest"))
    return rows.withColumn("h", F.xxhash64("doc_id", "digest", F.lit(5)))


def source_key() -> Column:
    """The source, told apart from a null one."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def text_digest() -> Column:
    return F.xxhash64("text", F.lit(3))


def targets(rows: DataFrame) -> DataFrame:
    """src, source_size, target: weights' shares of all words, none above MAX_REPEATS times its source.

    The excess of capped sources is shared by weight among the others. With sources in order
    of cap / weight, one is capped if, all before it capped, its share would exceed its cap.
    """
    total = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("src") == "", "src")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS))
    cap = F.lit(MAX_REPEATS) * F.col("source_size")
    order = Window.orderBy("level", "src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = total.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
    t = t.withColumns({"all": F.sum("source_size").over(every), "weights": F.sum("weight").over(every), "caps": F.coalesce(F.sum("cap").over(order), F.lit(0)), "taken": F.coalesce(F.sum("weight").over(order), F.lit(0))})
    t = t.withColumn("capped", (F.col("all") - F.col("caps")) / (F.col("weights") - F.col("taken")) > F.col("level"))
    left = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    open_weights = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    share = F.when(F.col("capped"), F.col("cap")).otherwise((F.col("all") - left) / open_weights * F.col("weight"))
    return t.select("src", "source_size", share.cast("double").alias("target"))


def _blocks(goals: DataFrame, words: int) -> DataFrame:
    """goals with each source's block length and count, and its interval [low, high) of slots."""
    block = min(MAX_BLOCK, max(1, words // SLOTS))
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.ceil(F.col("source_size") / MIN_BLOCKS))).cast("long")
    g = goals.withColumn("length", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
    need = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("blocks")).otherwise(0.0)
    run = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("upto", F.round(F.sum(need).over(run)).cast("long"))
    low = F.coalesce(F.lag("upto").over(Window.orderBy("src")), F.lit(0))
    return g.select("*", low.alias("low"), F.col("upto").alias("high"))


def _reversed(x: Column) -> Column:
    """The 64 bits of x in reverse order."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = F.shiftright(x, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), shift))
    return F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))


def schedule(goals: DataFrame) -> DataFrame:
    """slot, src, pass, block: what the mix takes, in order. goals: from ``_blocks``, written."""
    spark = goals.sparkSession
    slots = goals.agg(F.max("high")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(2, slots))))
    cell = max(1, (1 << bits) // _CELLS)
    point = F.shiftrightunsigned(_reversed(F.col("id")), 64 - bits)
    points = spark.range(1 << bits).select(F.col("id").alias("slot"), point.alias("point")).where(F.col("point") < slots)
    points = points.withColumn("cell", F.floor(F.col("point") / cell))
    spans = goals.where("high > low").select("src", "blocks", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))).alias("cell"))
    named = points.join(spans, "cell").where("point >= low and point < high").select("slot", "src", "blocks", F.floor(F.col("slot") / _STRETCH).alias("stretch"))
    run = Window.partitionBy("src").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = named.groupBy("src", "stretch").agg(F.count(F.lit(1)).alias("n")).select("src", "stretch", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("src", "stretch").orderBy("slot")) - 1
    ranked = named.join(before, ["src", "stretch"]).withColumn("rank", rank)
    taken = ranked.select("slot", "src", F.floor(F.col("rank") / F.col("blocks")).cast("int").alias("pass"), (F.col("rank") % F.col("blocks")).alias("block"))
    return taken.where(F.col("pass") < MAX_REPEATS)


def _pieces(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """For each document with words, where it starts in its source, and its words in each block."""
    part = F.shiftrightunsigned("h", 64 - _RANGE_BITS)
    rows = rows.where("size > 0").withColumn("part", part)
    run = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("src", "part").agg(F.sum("size").alias("n")).select("src", "part", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    own = Window.partitionBy("src", "part").orderBy("h", "digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("within", F.sum("size").over(own)).join(before, ["src", "part"]).withColumn("at", F.col("before") + F.col("within") - F.col("size"))
    placed = placed.join(goals.select("src", "source_size", "target", "length"), "src").select("doc_id", "src", "size", "digest", "h", "at", "source_size", "target", "length")
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / F.col("length")), F.floor((F.col("at") + F.col("size") - 1) / F.col("length")))))
    words = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("length")) - F.greatest(F.col("at"), F.col("block") * F.col("length"))
    return cut.withColumn("words", words)


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.write(sized(docs))
    goals = scratch.write(targets(rows))
    words = goals.agg(F.sum("source_size")).first()[0] or 0
    return rows, scratch.write(_blocks(goals, words))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    size: words of the text (null: 0); taken: words that the mix takes of the row, repeats
    counted, at most three times its size. Sources weigh 1, 2, 3, 1, ... in code point order,
    a null source last. Null and empty texts have size 0 and are never taken. Repeated rows are
    documents of their own; an empty table gives none. Texts of any length are counted whole. The result depends on the rows alone. Columns other than doc_id, text and source are ignored.
    """
    rows, goals = _prepared(docs)
    uses = schedule(goals).groupBy("src", "block").agg(F.count(F.lit(1)).alias("uses"))
    met = _pieces(rows, goals).join(uses, ["src", "block"], "left")
    full = met.groupBy("src", "at", "doc_id", "size", "source_size", "target").agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken"))
    none = rows.where("size = 0").join(goals, "src").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return full.select("doc_id", "size", "source_size", "target", "taken").union(none)


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of docs, each as often as passes take it, all columns.

    Where a pass ends within a document, that row's text is cut to the words taken (joined by
    one space, n_chars follows where present). Of rows with equal doc_id, source and text, the
    first by its other columns stands for all. Null and empty texts have no words and are never
    taken; an empty table gives none. Texts are shuffled once, to their takes.
    """
    rows, goals = _prepared(docs)
    met = _pieces(rows, goals).join(schedule(goals), ["src", "block"])
    takes = met.groupBy("src", "at", "pass", "h", "digest", "size").agg(F.sum("words").alias("take")).select("src", "h", "digest", "size", "take")
    mine, names = plain_names(docs, "doc_id", "text", "source")
    mine = mine.withColumns({"src": source_key(), "digest": text_digest()}).withColumn("h", F.xxhash64("doc_id", "digest", F.lit(5)))
    key = ["src", "h", "digest"]
    out = takes.join(one_of_each(mine, key, names), key)
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("take").cast("int")), " ")
    part = F.col("take") < F.col("size")
    out = out.withColumn("text", F.when(part, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        at = names[docs.columns.index("n_chars")]
        out = out.withColumn(at, F.when(part, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at)))
    return out.select(*names).toDF(*docs.columns)
