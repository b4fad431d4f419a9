"""Verbatim verification of proposed evidence, its ids and its de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import STATEMENT_CHARS, SUPPORT_CHARS
from ..functions.text import bounded, evidence_id, is_kind, normalise, strip


def page_number(page: Column, kind: T.DataType) -> Column:
    """A page number as it was given: numbers are cut towards zero, texts count if they are whole, true is 1.

    A variant keeps whether JSON had a number or a text, so 7.9 is page 7 and "7.9" is none.
    """
    whole = lambda x: F.when(F.regexp_like(x, F.lit(r"^\s*[+-]?[0-9]+\s*$")), F.trim(F.regexp_replace(x, r"\s", F.lit(""))).try_cast("int"))
    if isinstance(kind, T.StringType):
        return whole(page)
    if not isinstance(kind, T.VariantType):
        return page.try_cast("int")
    given = F.schema_of_variant(page)
    number = F.try_variant_get(page, "$", "double").try_cast("int")
    return F.when(given == "STRING", whole(F.try_variant_get(page, "$", "string"))).when(given.isin("VOID", "OBJECT<>"), None).otherwise(number)


def check_proposals(proposals: DataFrame, pages: DataFrame) -> DataFrame:
    """Proposals with ``accepted``.

    proposals: paper, chunk_index, ord, kind, statement, support, page (variant, text or number).
    pages: paper, chunk_index, number, text, as ``chunk_pages`` gives them. Accepted is a
    known kind, a statement and a support that are not blank, a page of the chunk, and a
    support (cut first) that its page holds, both normalised. The join is on (paper, chunk,
    page); texts are normalised once, before it.
    """
    number = page_number(F.col("page"), proposals.schema["page"].dataType)
    rows = proposals.select("paper", "chunk_index", "ord", F.lower(strip("kind")).alias("kind"), bounded("statement", STATEMENT_CHARS).alias("statement"), bounded("support", SUPPORT_CHARS).alias("support"), number.alias("page"))
    rows = rows.withColumn("needle", normalise("support"))
    held = pages.select("paper", "chunk_index", F.col("number").alias("page"), normalise("text").alias("hay"))
    met = rows.join(held, ["paper", "chunk_index", "page"], "left")
    ok = is_kind(F.col("kind")) & F.col("statement").isNotNull() & F.contains("hay", "needle")
    return met.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("hay", "needle")


def with_ids(checked: DataFrame) -> DataFrame:
    """Accepted proposals, numbered within their chunk: evidence_id, and ord as it was."""
    nth = F.row_number().over(Window.partitionBy("paper", "chunk_index").orderBy("ord"))
    return checked.where("accepted").select("paper", evidence_id(F.col("chunk_index"), nth).alias("evidence_id"), "chunk_index", "ord", "kind", "statement", "support", "page")


def first_claims(items: DataFrame) -> DataFrame:
    """The first of items with equal page and normalised support in a paper; ids keep their gaps."""
    order = Window.partitionBy("paper", "page", normalise("support")).orderBy("chunk_index", "ord")
    return items.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def chunk_error(accepted: Column, rejected: Column) -> Column:
    """What is wrong with a chunk that proposed something and of which nothing holds."""
    return F.when((F.coalesce(rejected, F.lit(0)) > 0) & (F.coalesce(accepted, F.lit(0)) == 0), "all proposed evidence failed source verification")


def rejected_counts(checked: DataFrame) -> DataFrame:
    """paper, chunk_index, accepted_items, rejected_items."""
    ok = F.col("accepted")
    return checked.groupBy("paper", "chunk_index").agg(F.count_if(ok).alias("accepted_items"), F.count_if(~ok).alias("rejected_items"))
