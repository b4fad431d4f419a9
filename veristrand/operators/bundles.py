"""Evidence bundles: the nested checkpoint of a synthesised paper, and when one may be reused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BUNDLE_VERSION, KINDS
from ..schemas import BUNDLE


def build(papers: DataFrame, chunks: DataFrame, items: DataFrame, roots: DataFrame, relations: DataFrame) -> DataFrame:
    """paper, source_corpus (JSON).

    papers: paper, paper_hash, model, page_count. chunks: paper, chunk_index, page_start,
    page_end, summary, rejected_items. roots: paper, page_start, page_end, ids, levels,
    summary. relations: paper, nth, ids, description.
    """
    fact = F.struct("evidence_id", F.col("chunk_index").cast("int").alias("chunk_index"), "kind", "statement", "support", F.col("page").cast("int").alias("page"))
    facts = items.groupBy("paper", "chunk_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", fact.alias("x")))), lambda r: r["x"]).alias("evidence"))
    none = F.from_json(F.lit("[]"), BUNDLE["chunks"].dataType.elementType["evidence"].dataType)
    part = chunks.join(facts, ["paper", "chunk_index"], "left")
    ints = [F.col(c).cast("int").alias(c) for c in ("chunk_index", "page_start", "page_end")]
    part = part.select("paper", F.struct(*ints, "summary", F.coalesce("evidence", none).alias("evidence"), F.col("rejected_items").cast("int").alias("rejected_items")).alias("chunk"))
    all_chunks = part.groupBy("paper").agg(F.sort_array(F.collect_list("chunk")).alias("chunks"))
    told = relations.groupBy("paper").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "ids", "description"))), lambda r: F.struct(r["ids"].alias("evidence_ids"), r["description"].alias("description"))).alias("told"))
    rows = papers.join(all_chunks, "paper").join(roots, "paper").join(told, "paper", "left")
    no_relations = F.array().cast(BUNDLE["root"].dataType["relationships"].dataType)
    root = F.struct(F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"), "summary", F.col("ids").alias("selected_evidence_ids"), F.coalesce("told", no_relations).alias("relationships"))
    bundle = F.struct(F.lit(BUNDLE_VERSION).alias("schema_version"), "paper_hash", "model", F.col("page_count").cast("int").alias("physical_page_count"), "chunks", root.alias("root"), F.col("levels").cast("int").alias("reduction_levels"))
    return rows.select("paper", F.to_json(bundle).alias("source_corpus"))


def is_reusable(bundle: Column, paper_hash: Column, model: Column) -> Column:
    """Of the right version, paper and model, with evidence of known kinds, and a root that selects among it."""
    facts = F.flatten(F.transform(bundle["chunks"], lambda c: c["evidence"]))
    kinds = F.forall(facts, lambda e: F.coalesce(e["kind"].isin(KINDS), F.lit(False)))
    chosen = F.size(F.array_except(bundle["root"]["selected_evidence_ids"], F.transform(facts, lambda e: e["evidence_id"]))) == 0
    same = (bundle["schema_version"] == BUNDLE_VERSION) & (bundle["paper_hash"] == paper_hash) & (bundle["model"] == model)
    return F.coalesce(same & (F.size(facts) > 0) & kinds & chosen, F.lit(False))


def reusable(papers: DataFrame) -> DataFrame:
    """papers (paper_hash, model_used, source_corpus, ...) with ``reusable``."""
    b = F.from_json("source_corpus", BUNDLE)
    return papers.withColumn("reusable", is_reusable(b, F.col("paper_hash"), F.col("model_used")))
