"""The engine's frames out of the driver's tables.

A document is a paper and each of its lines a page; chunks, proposals, evidence, relations
and stored rows are derived by fixed rules, so every query has one right result.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SECTIONS
from ..operators import chunks, evidence, pages
from ..session import cut_lineage
from ..sources.generator import extractive_proposals, map_prompt


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str, per_trigger: int = 64) -> DataFrame:
    """A table's files as a stream. The pattern lets one file stand for a folder."""
    return spark.readStream.schema(read(spark, sf_dir, name).schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{sf_dir}/{name}.parque[t]")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper"), "text")


def paper_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.explode_pages(papers(spark, sf_dir)).withColumn("method", F.lit("native"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of each chunk."""
    frags = chunks.fragments(paper_pages(spark, sf_dir))
    return chunks.chunk_fragments(frags, chunks.chunk_bounds(frags))


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members as a checkpoint, for plans that read them more than once: documents are scanned twice in all."""
    return cut_lineage(members(spark, sf_dir))


def checked(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """Proposals out of members (found, where they are at hand), judged."""
    found = written(spark, sf_dir) if found is None else found
    return evidence.check_proposals(extractive_proposals(found), chunks.chunk_pages(found))


def stubborn(model: str, prompt: str) -> str:
    """A generator by chunk number, mod 5: 1 gives no object at first, 2 a made-up quote at first, 3 always; the others quote the first page."""
    again = "failed validation" in prompt
    rest = int(re.search(r"Chunk: (\d+)", prompt)[1]) % 5
    number, line = re.search(r"\[PAGE (\d+)\]\n([^\n]*)", prompt).groups()
    if rest == 1 and not again:
        return "Here is what I found."
    support = f"never said: {line[:40]}" if rest == 3 or rest == 2 and not again else line[:60]
    return json.dumps({"chunk_summary": "a chunk", "evidence": [{"kind": "method", "statement": "said", "support": support, "page": int(number)}]})


def asked(held: DataFrame, found: DataFrame) -> DataFrame:
    """Prompts for chunks (members found, their pages held): paper, chunk_index, model, prompt."""
    numbers = held.groupBy("paper", "chunk_index").agg(F.sort_array(F.collect_set("number")).alias("numbers"))
    rows = chunks.render(found).join(numbers, ["paper", "chunk_index"])
    return rows.select("paper", "chunk_index", F.lit("m").alias("model"), map_prompt(F.col("content"), F.col("chunk_index"), F.col("numbers")).alias("prompt"))


def items(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """De-duplicated evidence."""
    return evidence.first_claims(evidence.with_ids(checked(spark, sf_dir, found)))


def completed(doc_id: str = "doc_id") -> Column:
    """A paper's completed sections: those with (doc_id + position) not divisible by three; every fifth paper all."""
    every = F.array(*map(F.lit, SECTIONS))
    return F.when(F.col(doc_id) % 5 == 0, every).otherwise(F.filter(every, lambda s: (F.col(doc_id) + F.array_position(every, s)) % 3 != 0))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored papers: paper_hash, doc_id, pdf_path, sections_completed, updated_at."""
    d = read(spark, sf_dir, "documents")
    path = F.concat(F.lit("/papers/"), "source", F.lit("/"), (F.col("doc_id") % 10).cast("string"), F.lit(".pdf"))
    return d.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("paper_hash"), "doc_id", path.alias("pdf_path"), completed().alias("sections_completed"), F.col("n_chars").cast("string").alias("updated_at"))


def lease_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a lease log: signup claims, error claims for another owner, view and click renew, purchase releases."""
    return as_leases(read(spark, sf_dir, "events"))


def as_leases(e: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type").isin("signup", "error"), "claim").when(F.col("event_type") == "purchase", "release").otherwise("renew")
    owner = F.when(F.col("event_type") == "error", "other").otherwise("own")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("user_id").alias("key"), "event_id", ts.alias("ts"), kind.alias("kind"), owner.alias("owner"), (F.col("event_id") % 3 + 1).alias("generation"))


def relations(found: DataFrame) -> DataFrame:
    """Relations proposed for each chunk with two or more items: its ids in order, twice over, and one unknown id in every third chunk."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("ord", "evidence_id"))), lambda x: x["evidence_id"])
    rows = found.groupBy("paper", "chunk_index").agg(ids.alias("own")).where("size(own) > 1")
    asked = F.concat("own", F.slice("own", 1, 1), F.when(F.col("chunk_index") % 3 == 0, F.array(F.lit("C999-E999"))).otherwise(F.array().cast("array<string>")))
    return rows.select("paper", F.col("chunk_index").alias("nth"), asked.alias("ids"), F.concat(F.lit(" chunk "), F.col("chunk_index").cast("string"), F.lit(" ")).alias("description"), F.col("own").alias("selected"))
