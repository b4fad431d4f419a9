"""Property graph of papers, evidence and diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import GRAPH_CHARS
from ..schemas import BUNDLE


def parsed(papers: DataFrame) -> DataFrame:
    """papers (paper_hash, paper_name, model_used, page_count, source_corpus) with ``bundle``; unreadable ones go."""
    return papers.withColumn("bundle", F.from_json("source_corpus", BUNDLE)).where(F.col("bundle").isNotNull() & F.col("bundle.paper_hash").isNotNull())


def evidence_nodes(bundles: DataFrame) -> DataFrame:
    """qid, paper_hash, evidence_id, kind, statement, support, page. Of equal ids in a paper the last one holds."""
    flat = bundles.select("paper_hash", F.posexplode("bundle.chunks").alias("c", "chunk")).select("paper_hash", "c", F.posexplode("chunk.evidence").alias("e", "item"))
    cut = lambda c: F.substring(F.col(c), 1, GRAPH_CHARS)
    rows = flat.select("paper_hash", "c", "e", F.concat_ws(":", "paper_hash", "item.evidence_id").alias("qid"), "item.evidence_id", "item.kind", cut("item.statement").alias("statement"), cut("item.support").alias("support"), "item.page")
    last = F.max_by(F.struct("paper_hash", "evidence_id", "kind", "statement", "support", "page"), F.struct("c", "e"))
    return rows.groupBy("qid").agg(last.alias("v")).select("qid", "v.*")


def relation_pairs(relations: DataFrame) -> DataFrame:
    """relations (paper_hash, nth, ids, description) -> each pair in list order: paper_hash, a, b, seq, description."""
    ids = relations.select("paper_hash", "nth", "description", F.posexplode("ids").alias("i", "a"), "ids")
    rest = F.slice("ids", F.col("i") + 2, F.size("ids"))
    pairs = ids.select("paper_hash", "nth", "description", "i", "a", F.posexplode(rest).alias("j", "b"))
    return pairs.select("paper_hash", "a", "b", F.struct("nth", "i", "j").alias("seq"), F.substring("description", 1, GRAPH_CHARS).alias("description"))


def relates_to(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, description between nodes that exist; the last description of a pair holds."""
    last = pairs.groupBy("paper_hash", "a", "b").agg(F.max_by("description", "seq").alias("description"))
    edges = last.select(F.concat_ws(":", "paper_hash", "a").alias("src"), F.concat_ws(":", "paper_hash", "b").alias("dst"), "description")
    known = nodes.select("qid")
    return edges.join(known.withColumnRenamed("qid", "src"), "src", "left_semi").join(known.withColumnRenamed("qid", "dst"), "dst", "left_semi")


def owned_graph(papers: DataFrame, diagrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (paper_hash, id, type, label) and edges (paper_hash, src, dst, type, description): every row is one paper's."""
    bundles = parsed(papers)
    facts = evidence_nodes(bundles)
    drawn = diagrams.join(bundles.select("paper_hash"), "paper_hash", "left_semi").select(F.concat_ws("#", "paper_hash", F.col("idx").cast("string")).alias("id"), "paper_hash", "title")
    relations = bundles.select("paper_hash", F.posexplode("bundle.root.relationships").alias("nth", "r")).select("paper_hash", "nth", F.col("r.evidence_ids").alias("ids"), F.col("r.description").alias("description"))
    nodes = bundles.select("paper_hash", F.col("paper_hash").alias("id"), F.lit("Paper").alias("type"), F.coalesce("paper_name", "paper_hash").alias("label")).distinct()
    nodes = nodes.unionByName(facts.select("paper_hash", F.col("qid").alias("id"), F.lit("Evidence").alias("type"), F.col("evidence_id").alias("label")))
    nodes = nodes.unionByName(drawn.select("paper_hash", "id", F.lit("Diagram").alias("type"), F.coalesce("title", "id").alias("label")))
    none = F.lit(None).cast("string").alias("description")
    edges = facts.select("paper_hash", F.col("paper_hash").alias("src"), F.col("qid").alias("dst"), F.lit("HAS_EVIDENCE").alias("type"), none)
    edges = edges.unionByName(drawn.select("paper_hash", F.col("paper_hash").alias("src"), F.col("id").alias("dst"), F.lit("HAS_DIAGRAM").alias("type"), none))
    related = relates_to(relation_pairs(relations), facts).withColumn("paper_hash", F.substring_index("src", ":", 1))
    return nodes, edges.unionByName(related.select("paper_hash", "src", "dst", F.lit("RELATES_TO").alias("type"), "description"))


def graph(papers: DataFrame, diagrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, type, label) and edges (src, dst, type, description)."""
    nodes, edges = owned_graph(papers, diagrams)
    return nodes.drop("paper_hash"), edges.drop("paper_hash")


def graph_changes(papers: DataFrame, diagrams: DataFrame, seen: DataFrame) -> DataFrame:
    """paper_hash, digest, change (new, changed, gone) of papers whose part of a graph is no longer what seen (paper_hash, digest) says.

    The digest is of all that a paper's nodes and edges are made of; a paper whose bundle can't
    be read has no part.
    """
    drawn = diagrams.groupBy("paper_hash").agg(F.sort_array(F.collect_list(F.struct("idx", "title"))).alias("drawn"))
    made = parsed(papers).join(drawn, "paper_hash", "left").select("paper_hash", F.sha2(F.to_json(F.struct("paper_name", "source_corpus", "drawn")), 256).alias("digest"))
    met = made.join(seen.select("paper_hash", F.col("digest").alias("was")), "paper_hash", "full")
    change = F.when(F.col("digest").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("digest") != F.col("was"), "changed")
    return met.select("paper_hash", "digest", change.alias("change")).where("change is not null")


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at either end of an edge; all nodes where there is no edge at all."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    none = edges.limit(1).agg(F.count(F.lit(1)).alias("__edges"))
    linked = nodes.join(ends, "id", "left_semi")
    every = nodes.join(F.broadcast(none.where("__edges = 0").drop("__edges").withColumn("__all", F.lit(True))), F.lit(True), "left_semi")  # one row at most
    return linked.unionByName(every)


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    """One node by id, or no row."""
    return nodes.where(F.col("id") == node_id)


def import_totals(bundles: DataFrame) -> DataFrame:
    """paper_hash, evidence, relations: items and relation attempts, whether or not both ends exist."""
    items = F.aggregate(F.coalesce(F.transform("bundle.chunks", lambda c: F.coalesce(F.size(c["evidence"]), F.lit(0))), F.array().cast("array<int>")), F.lit(0), lambda a, n: a + n)
    size = lambda r: F.coalesce(F.size(r["evidence_ids"]), F.lit(0))
    pairs = F.aggregate(F.coalesce(F.transform("bundle.root.relationships", lambda r: (size(r) * (size(r) - 1) / 2).cast("int")), F.array().cast("array<int>")), F.lit(0), lambda a, n: a + n)
    return bundles.select("paper_hash", items.cast("long").alias("evidence"), pairs.cast("long").alias("relations"))
