"""Overlapping windows over pages, bounded by pages and by characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CHAR_CAP, FRAGMENT_CHARS_EXTRA, FRAGMENT_SLACK, MIN_CHAR_CAP, OVERLAP, WINDOW


def check_windows(window: int, overlap: int, char_cap: int) -> None:
    if window < 1 or not 0 <= overlap < window or char_cap < MIN_CHAR_CAP:
        raise ValueError(f"windows of {window} pages, {overlap} of them shared, of {char_cap} characters")


def fragments(pages: DataFrame, char_cap: int = CHAR_CAP) -> DataFrame:
    """paper, pos (from 0), number, part (from 0), text, method: long pages in fixed slices."""
    cap = max(MIN_CHAR_CAP, char_cap - FRAGMENT_SLACK)
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(cap))
    cut = pages.select("paper", "number", "method", F.posexplode(F.transform(starts, lambda s: F.substring(F.col("text"), s + 1, F.lit(cap)))).alias("part", "text"))
    pos = F.row_number().over(Window.partitionBy("paper").orderBy("number", "part")) - 1
    return cut.select("paper", pos.alias("pos"), "number", "part", "text", "method")


#: Windows are listed by stretches of so many fragments, since a list is copied to append to it.
_STRETCH = 1024


def chunk_bounds(frags: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, char_cap: int = CHAR_CAP) -> DataFrame:
    """paper, chunk_index (from 1), first, last: the windows as ranges of pos.

    Where a window from each fragment would end follows from running sums of lengths. The next
    window's start follows from that end and lies behind this one's, so one pass over a
    paper's fragments, which carries the next start, names the windows; texts stay out of it.
    """
    check_windows(window, overlap, char_cap)
    run = Window.partitionBy("paper").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sizes = frags.select("paper", "pos", (F.length("text") + FRAGMENT_CHARS_EXTRA).cast("long").alias("n"))
    sums = sizes.withColumn("upto", F.sum("n").over(run)).groupBy("paper").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "upto"))), lambda x: x["upto"]).alias("upto"))
    fits = lambda i: F.size(F.filter(F.slice("upto", i + 2, F.lit(window - 1)), lambda x: x - F.coalesce(F.get("upto", i - 1), F.lit(0)) <= char_cap))
    ends = sums.select("paper", F.transform("upto", lambda _, i: i + fits(i)).alias("last"))
    total = F.size("last")
    after = lambda i, last: F.when(last + 1 == total, total).otherwise(F.greatest(i + 1, last + 1 - F.least(F.lit(overlap), last - i)))
    none = F.array().cast("array<struct<first:int,last:int>>")

    def step(state: Column, i: Column) -> Column:
        last = F.get("last", i)
        taken = F.struct(after(i, last).cast("int").alias("at"), F.array_append(state["out"], F.struct(i.alias("first"), last.alias("last"))).alias("out"))
        return F.when(i == state["at"], taken).otherwise(state)

    def stretch(state: Column, low: Column) -> Column:
        own = F.sequence(low, F.least(low + _STRETCH, total) - 1)
        done = F.aggregate(own, F.struct(state["at"].alias("at"), none.alias("out")), step)
        return F.struct(done["at"].alias("at"), F.array_append(state["out"], done["out"]).alias("out"))

    lows = F.sequence(F.lit(0), total - 1, F.lit(_STRETCH))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<first:int,last:int>>>").alias("out"))
    listed = F.aggregate(lows, start, stretch, lambda s: F.flatten(s["out"]))
    return ends.select("paper", F.posexplode(listed).alias("nth", "w")).select("paper", (F.col("nth") + 1).alias("chunk_index"), "w.first", "w.last")


def chunk_fragments(frags: DataFrame, bounds: DataFrame) -> DataFrame:
    """Fragments of each chunk: paper, chunk_index, pos, number, part, text, method.

    The ranges are laid out as rows, so the join is on (paper, pos), both sides dealt alike.
    """
    laid = bounds.select("paper", "chunk_index", F.explode(F.sequence("first", "last")).alias("pos"))
    return laid.join(frags, ["paper", "pos"]).select("paper", "chunk_index", "pos", "number", "part", "text", "method")


def chunk_pages(members: DataFrame) -> DataFrame:
    """paper, chunk_index, number, text: a page's fragments within one chunk, each behind a space."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return members.groupBy("paper", "chunk_index", "number").agg(F.array_join(F.transform(parts, lambda x: F.concat(F.lit(" "), x["text"])), "").alias("text"))


def chunk_summary(members: DataFrame) -> DataFrame:
    """paper, chunk_index, page_start, page_end, fragments, chars."""
    n = F.count(F.lit(1))
    return members.groupBy("paper", "chunk_index").agg(F.min("number").alias("page_start"), F.max("number").alias("page_end"), n.alias("fragments"), F.sum(F.length("text")).alias("chars"))


def render(members: DataFrame) -> DataFrame:
    """paper, chunk_index, content: fragments under their page numbers."""
    parts = F.sort_array(F.collect_list(F.struct("pos", F.concat(F.format_string("[PAGE %d]\n", "number"), "text").alias("text"))))
    return members.groupBy("paper", "chunk_index").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("content"))
