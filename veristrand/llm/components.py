"""Connected components of a link table, without gathering links anywhere.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond"): each round is two partial-aggregated minima and two joins whose
large side AQE may split, so a hub with a third of all links stays spread out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, root): each linked node and the smallest node reachable.

    Nulls and self-links are ignored; nodes without links are absent from the result.
    """
    e = scratch.write(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        if _is_stars(e):
            return e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))).alias("x")).select("x.*").distinct()
        new = scratch.write(_small_star(_large_star(e)))
        scratch.drop(e)
        e = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(e: DataFrame) -> bool:
    """Whether each node either hangs on one root or is a root."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("root")), F.struct(F.col("v").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))).alias("p")).select("p.*")
    bad = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root")).where("leaf > 1 or (leaf = 1 and root = 1)")
    return bad.isEmpty()
