"""Status reports as joins and conditional aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import IDENTITY_SCHEME, PAPER_STATUSES, SCHEMA_VERSION
from ..session import cut_lineage
from .store import is_complete, latest, missing_sections


def paper_status(files: DataFrame, papers: DataFrame, leases: DataFrame) -> DataFrame:
    """pdf_path, status, missing, in_progress of each file.

    files: pdf_path, content_hash (only read for files that no paper knows). papers:
    pdf_path, paper_hash, sections_completed, updated_at. leases: resource_key of live ones.
    One join each in place of a lookup per file.
    """
    newest = latest(papers, "pdf_path", F.desc("updated_at"), "paper_hash").select("pdf_path", "paper_hash", "sections_completed")
    met = files.join(newest, "pdf_path", "left")
    key = F.concat(F.lit("sha256:"), F.coalesce("paper_hash", "content_hash"))
    live = leases.select(F.col("resource_key").alias("__key")).distinct().withColumn("live", F.lit(True))
    met = met.withColumn("__key", key).join(live, "__key", "left")
    known = F.col("paper_hash").isNotNull()
    done = is_complete(F.col("sections_completed"))
    status = F.when(~known, "not started").when(done, "complete").otherwise("partial")
    missing = F.when(known & ~done, missing_sections(F.col("sections_completed"))).otherwise(F.array().cast("array<string>"))
    return met.select("pdf_path", status.alias("status"), missing.alias("missing"), F.coalesce("live", F.lit(False)).alias("in_progress"))


def batch_progress(status: DataFrame) -> DataFrame:
    """One row: total, complete, partial, not_started."""
    n = lambda s: F.count_if(F.col("status") == s)
    return status.agg(F.count(F.lit(1)).alias("total"), n("complete").alias("complete"), n("partial").alias("partial"), n("not started").alias("not_started"))


def entity_report(papers: DataFrame, diagrams: DataFrame, cache: DataFrame, leases: DataFrame) -> DataFrame:
    """entity, metric, value of each table."""
    one = lambda df, entity, **aggs: df.agg(*(a.alias(n) for n, a in aggs.items())).select(F.lit(entity).alias("entity"), F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("string").alias("value")) for n in aggs))).alias("x")).select("entity", "x.*")
    n, svg = F.count(F.lit(1)), F.col("svg_content")
    parts = [
        one(papers, "papers", total=n, complete=F.count_if(is_complete(F.col("sections_completed")))),
        one(diagrams, "diagrams", total=n, rendered=F.count_if(svg.isNotNull()), failed=F.count_if(svg.isNull())),
        one(cache, "ocr_cache", total=n),
        one(leases, "processing_leases", total=n, active=F.count_if("active")),
        one(papers.limit(1), "schema_meta", version=F.lit(SCHEMA_VERSION), identity=F.lit(IDENTITY_SCHEME)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def status_histogram(results: DataFrame) -> DataFrame:
    """ord, status, n of the statuses that occur, in their fixed order."""
    rank = F.array_position(F.array(*map(F.lit, PAPER_STATUSES)), F.col("status")).cast("int")
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(rank.alias("ord"), "status", "n")


def tier_order(papers: DataFrame) -> DataFrame:
    """papers (model, path) with ``ord`` (from 1): models together, so that each is loaded once.

    Ranks within ranges of the order, then adds the ranges' running totals: no task sorts
    the whole.
    """
    ranged = cut_lineage(by_model(papers).withColumn("__part", F.spark_partition_id()))
    run = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy("model", "path"))
    return ranged.join(before, "__part").withColumn("ord", F.col("__before") + nth).drop("__part", "__before")


def by_model(papers: DataFrame) -> DataFrame:
    """papers dealt out by model, sorted within, for a generator that holds one model at a time."""
    return papers.repartitionByRange("model", "path").sortWithinPartitions("model", "path")
