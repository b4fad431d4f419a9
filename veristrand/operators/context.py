"""A section's bounded context out of a synthesised paper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CONTEXT_CAPS
from .synthesis import coverage_order, remainder_order, skip_fit

# Headings of a context, and the share of it that chunk lines may fill.
_HEADER = "# Hierarchical evidence synthesis\nPhysical pages: %d\nEvidence records: %d\nReduction levels: %d\n\n## Root synthesis\n%s\n"
_CHUNKS, _EVIDENCE, _RELATIONS = "\n## Chunk coverage\n", "\n## Verified evidence\n", "\n## Supported relationships\n"
_CHUNK_SHARE = 0.42


def contexts(papers: DataFrame, chunks: DataFrame, items: DataFrame, relations: DataFrame, section: str, cap: int | None = None) -> DataFrame:
    """paper, context, error.

    papers: paper, page_count, levels, summary, ids (root's selection, in order). chunks:
    paper, chunk_index, page_start, page_end, summary. items: as ``first_claims`` gives them.
    relations: paper, nth, ids, description. Chunk lines and evidence skip what doesn't fit,
    relationships stop at it. Where the header alone fills the cap, error says so.
    """
    cap = CONTEXT_CAPS[section] if cap is None else cap
    count = items.groupBy("paper").agg(F.count(F.lit(1)).alias("records"))
    head = papers.join(count, "paper", "left").select("paper", "ids", F.format_string(_HEADER, "page_count", F.coalesce("records", F.lit(0)), "levels", "summary").alias("head"))

    line = F.format_string("- Pages %d–%d: %s\n", "page_start", "page_end", "summary")
    lines = coverage_order(chunks.select("paper", "chunk_index", "page_start", "page_end", line.alias("entry")), ["paper"], ["page_start", "page_end"], "chunk_index")
    lines = _listed(lines, "lines")

    entry = F.format_string('[%s] %s; page %d\nClaim: %s\nExact support: "%s"\n\n', "evidence_id", "kind", "page", "statement", "support")
    items = items.select("paper", "evidence_id", "kind", "page", entry.alias("entry"))
    chosen = papers.select("paper", F.posexplode("ids").alias("nth", "evidence_id")).join(items, ["paper", "evidence_id"])
    chosen = coverage_order(chosen, ["paper"], ["page"], "nth").select("paper", F.lit(0).alias("tier"), "ord", "entry")
    rest = remainder_order(items.join(papers.select("paper", F.explode("ids").alias("evidence_id")), ["paper", "evidence_id"], "left_anti"), section)
    facts = _listed(chosen.unionByName(rest.select("paper", F.lit(1).alias("tier"), "ord", "entry")), "facts", "tier")
    told = relations.select("paper", F.lit(0).alias("tier"), F.col("nth").alias("ord"), F.concat(F.lit("- "), F.array_join("ids", ", "), F.lit(": "), "description", F.lit("\n")).alias("entry"))

    none = F.array().cast("array<string>")
    rows = head.join(lines, "paper", "left").join(facts, "paper", "left").join(_listed(told, "told", "tier"), "paper", "left")
    rows = rows.select("paper", "head", *(F.coalesce(c, none).alias(c) for c in ("lines", "facts", "told")))
    rows = rows.withColumn("top", F.concat("head", F.lit(_CHUNKS), F.array_join(skip_fit(F.col("lines"), F.length, F.length("head") + len(_CHUNKS), int(cap * _CHUNK_SHARE)), "")))
    rows = rows.withColumn("body", F.concat("top", F.lit(_EVIDENCE), F.array_join(skip_fit(F.col("facts"), F.length, F.length("top") + len(_EVIDENCE), cap), "")))
    used = F.length("body") + len(_RELATIONS)
    fits = F.aggregate("told", F.struct(used.cast("long").alias("used"), F.lit("").alias("text"), F.lit(True).alias("go")), lambda a, e: F.when(a["go"] & (a["used"] + F.length(e) <= cap), F.struct((a["used"] + F.length(e)).cast("long").alias("used"), F.concat(a["text"], e).alias("text"), F.lit(True).alias("go"))).otherwise(F.struct(a["used"].alias("used"), a["text"].alias("text"), F.lit(False).alias("go"))), lambda a: a["text"])
    over = F.length("head") >= cap
    return rows.select("paper", F.when(~over, F.concat("body", F.lit(_RELATIONS), fits)).alias("context"), F.when(over, F.lit("the root synthesis fills the context")).alias("error"))


def _listed(rows: DataFrame, name: str, *first: str) -> DataFrame:
    return rows.groupBy("paper").agg(F.transform(F.sort_array(F.collect_list(F.struct(*first, "ord", "entry"))), lambda x: x["entry"]).alias(name))
