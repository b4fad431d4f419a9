"""Documents to physical pages; routing of pages with little text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import OCR_BUDGET, OCR_MIN_CHARS
from ..functions.text import strip


def explode_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """paper, number (from 1), text: one row per line, numbered before anything is dropped."""
    return docs.select("paper", F.posexplode(F.split(text, "\n")).alias("at", "text")).select("paper", (F.col("at") + 1).alias("number"), "text")


def needs_ocr(text: Column, least: int = OCR_MIN_CHARS) -> Column:
    return F.length(strip(text)) < least


def route_pages(pages: DataFrame, cache: DataFrame, mode: str = "auto", available: bool = True, budget: int = OCR_BUDGET, least: int = OCR_MIN_CHARS, profile: str | None = None) -> DataFrame:
    """Each page's route and the text it yields.

    pages: paper, number, text, ocr (what reading its image would give). cache: paper,
    page_idx (from 0), text. Result: paper, number, native, wants, cached, capped, text,
    method; text is null for a page left blank. A cached page is free, even one cached
    empty, under the profile if one is given (column ocr_profile); a fresh one counts against the budget of its paper (0: no limit), in page order.
    """
    if mode not in ("auto", "always", "never"):
        raise ValueError(f"unknown mode {mode!r}: auto, always or never")
    if profile is not None:
        cache = cache.where(F.col("ocr_profile") == profile)
    native = strip("text")
    wants = F.lit(available and mode != "never") & (F.lit(mode == "always") | (F.length(native) < least))
    hits = cache.select("paper", (F.col("page_idx") + 1).alias("number"), F.col("text").alias("hit"))
    rows = pages.select("paper", "number", native.alias("native"), wants.alias("wants"), "ocr").join(hits, ["paper", "number"], "left")
    rows = rows.withColumn("cached", F.col("wants") & F.col("hit").isNotNull())
    fresh = F.col("wants") & ~F.col("cached")
    nth = F.sum(F.when(fresh, 1).otherwise(0)).over(Window.partitionBy("paper").orderBy("number"))
    rows = rows.withColumn("capped", fresh & (nth > budget) if budget else F.lit(False))
    read = F.col("wants") & ~F.col("capped")
    got = F.when(F.col("cached"), strip("hit")).when(read, F.coalesce("ocr", F.lit("")))
    rows = rows.withColumn("got", got)
    text = F.nullif(F.coalesce(F.nullif("got", F.lit("")), "native"), F.lit(""))
    method = F.when(F.col("cached"), "ocr-cache").when(F.col("got") != "", "ocr").otherwise("native")
    return rows.select("paper", "number", "native", "wants", "cached", "capped", text.alias("text"), F.when(text.isNotNull(), method).alias("method"))


def extracted(routed: DataFrame) -> DataFrame:
    """paper, number, text, method of the pages that yield text; numbers stay as they were."""
    return routed.where("text is not null").select("paper", "number", "text", "method")


def ocr_stats(papers: DataFrame, routed: DataFrame) -> DataFrame:
    """Page counts of each paper, also of those without pages.

    A page read afresh to no avail that falls back to its native text counts as read, not as
    native.
    """
    plain = ~F.col("wants") | F.col("capped")
    n = lambda c, name: F.coalesce(F.count_if(c), F.lit(0)).alias(name)
    counts = routed.groupBy("paper").agg(
        F.count(F.lit(1)).alias("total_pages"), n(plain & F.col("text").isNotNull(), "native_pages"), n(F.col("wants") & ~F.col("cached") & ~F.col("capped"), "ocr_pages"),
        n(F.col("cached"), "cached_pages"), n(F.col("text").isNull(), "skipped_blank"), n(F.col("capped"), "ocr_capped"),
    )
    names = ["total_pages", "native_pages", "ocr_pages", "cached_pages", "skipped_blank", "ocr_capped"]
    return papers.select("paper").join(counts, "paper", "left").select("paper", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names))


def ocr_summary() -> Column:
    """The counts of ``ocr_stats`` as one line."""
    none = (F.col("ocr_pages") == 0) & (F.col("cached_pages") == 0)
    bits = [F.when(F.lit(c == "native_pages") | (F.col(c) > 0), F.concat(F.col(c).cast("string"), F.lit(" " + word))) for c, word in (("native_pages", "native"), ("ocr_pages", "OCR'd"), ("cached_pages", "cached"), ("skipped_blank", "still-blank"), ("ocr_capped", "budget-capped"))]
    return F.when(none, F.format_string("%d/%d pages had native text (no OCR needed)", "native_pages", "total_pages")).otherwise(F.concat(F.format_string("%d pages → ", "total_pages"), F.concat_ws(", ", *bits)))
