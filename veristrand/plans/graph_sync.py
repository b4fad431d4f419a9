"""The property graph as tables that follow the stored papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, store
from ..schemas import GRAPH_EDGES, GRAPH_NODES, GRAPH_PAPERS
from ..session import cut_lineage
from ..sources.tables import Table, update


class GraphTables:
    """Papers seen with their digests, nodes and edges, below one root folder; rows change by paper."""

    def __init__(self, spark: SparkSession, root: str):
        of = lambda name, schema: Table(spark, root, name, schema, ("paper_hash",))
        self.papers, self.nodes, self.edges = of("graph_papers", GRAPH_PAPERS), of("graph_nodes", GRAPH_NODES), of("graph_edges", GRAPH_EDGES)

    def read(self) -> tuple[DataFrame, DataFrame]:
        """nodes and edges, as ``graph.graph`` makes them of the papers last synced."""
        version = self.nodes.version()
        return self.nodes.read(version).drop("paper_hash"), self.edges.read(version).drop("paper_hash")


def sync_graph(tables: GraphTables, papers: DataFrame, diagrams: DataFrame) -> DataFrame:
    """Bring the graph up to papers and diagrams in one commit; paper_hash and change of what it took.

    Only papers that are new, changed or gone since are read for their nodes and edges, and
    only their rows are written; without any there is no commit.
    """
    out: list[DataFrame] = []

    def change(version: int) -> list[DataFrame] | None:
        found = cut_lineage(graph.graph_changes(papers, diagrams, tables.papers.read(version)))
        out[:] = [found]
        if found.isEmpty():
            return None
        there = found.where("change <> 'gone'")
        nodes, edges = graph.owned_graph(papers.join(there.select("paper_hash"), "paper_hash", "left_semi"), diagrams)
        return [store.replaced(rows, found) for rows in (there.select("paper_hash", "digest"), nodes, edges)]

    update([tables.papers, tables.nodes, tables.edges], change)
    return out[0].select("paper_hash", F.col("change"))
