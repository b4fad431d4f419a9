"""Versioned tables: a change is a new version of the rows it touches.

Plain Parquet tables know no MERGE, so each operator returns the table's next state as a
DataFrame; ``veristrand.sources.tables`` writes states under new paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SECTION_COLUMNS, SECTIONS

#: Columns that an upsert takes from the incoming row.
META = ["paper_name", "pdf_path", "page_count", "model_used", "code_model_used", "strategy", "processed_at"]


#: Marks, in a delta, a key that has no row any more.
GONE = "__gone"


def merged(base: DataFrame, deltas: list[DataFrame], key: list[str]) -> DataFrame:
    """base with deltas (oldest first; the columns of base and ``GONE``) on top: of each key the newest delta that names it counts.

    Only rows of deltas are ordered; the base is read past their keys, which are few.
    """
    if not deltas:
        return base
    rows = deltas[0].withColumn("__seq", F.lit(0))
    for i, d in enumerate(deltas[1:], 1):
        rows = rows.unionByName(d.withColumn("__seq", F.lit(i)))
    newest = rows.withColumn("__n", F.rank().over(Window.partitionBy(*key).orderBy(F.desc("__seq")))).where("__n = 1")
    left = base.join(rows.select(*key).distinct(), key, "left_anti")
    return left.select(*base.columns).unionByName(newest.where(f"not {GONE}").select(*base.columns))


def touched(writes: DataFrame, log: DataFrame) -> DataFrame:
    """writes (write_id, key, base, at) with ``conflict``: whether log (version, key) has a version after base and before at that wrote the key.

    One union ordered by version carries the last write of a key to what comes after it.
    """
    a = log.select("key", F.col("version").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("write_id"), F.lit(None).cast("long").alias("base"), F.col("version").alias("last"))
    b = writes.select("key", "at", F.lit(-1).alias("side"), "write_id", "base", F.lit(None).cast("long").alias("last"))
    run = Window.partitionBy("key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("last", F.last("last", ignorenulls=True).over(run)).where("side = -1")
    return met.select("write_id", "key", "base", "at", F.coalesce(F.col("last") > F.col("base"), F.lit(False)).alias("conflict"))


def all_sections() -> Column:
    return F.array(*map(F.lit, SECTIONS))


def is_complete(completed: Column) -> Column:
    return F.size(F.array_except(all_sections(), F.coalesce(completed, F.array().cast("array<string>")))) == 0


def missing_sections(completed: Column) -> Column:
    return F.array_sort(F.array_except(all_sections(), F.coalesce(completed, F.array().cast("array<string>"))))


def needs_section(section: Column, completed: Column, reprocess: str | None = None) -> Column:
    """Whether a section is still to be written, or asked for again."""
    if reprocess == "all":
        return F.lit(True)
    return ~F.array_contains(completed, section) | F.coalesce(section == F.lit(reprocess), F.lit(False))


def pending_sections(papers: DataFrame, reprocess: str | None = None) -> DataFrame:
    """paper_hash, section, ord of what is still to be done."""
    every = papers.select("paper_hash", "sections_completed", F.posexplode(all_sections()).alias("ord", "section"))
    return every.where(needs_section(F.col("section"), F.col("sections_completed"), reprocess)).select("paper_hash", "section", "ord")


def latest(rows: DataFrame, key: str, *newest: Column) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*newest))).where("__n = 1").drop("__n")


def upsert_meta(table: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """Next state of papers: incoming metadata wins, but sections and created_at stay, and so does a corpus once there.

    incoming: paper_hash, the META columns and source_corpus, one row per hash.
    """
    new = incoming.select(F.col("paper_hash").alias("__key"), *(F.col(c).alias(f"__{c}") for c in [*META, "source_corpus"]))
    both = table.join(new, table["paper_hash"] == new["__key"], "full")
    hit = F.col("__key").isNotNull()
    values = {c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in META}
    values |= {
        "paper_hash": F.coalesce("paper_hash", "__key"),
        "source_corpus": F.coalesce("source_corpus", "__source_corpus"),
        "sections_completed": F.coalesce("sections_completed", F.array().cast("array<string>")),
        "created_at": F.coalesce("created_at", F.lit(now)),
        "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")),
    }
    return both.select(*(values.get(c, F.col(c)).alias(c) for c in table.columns))


def write_corpus(table: DataFrame, corpora: DataFrame, now: str) -> DataFrame:
    """Next state of papers with corpora (paper_hash, source_corpus) put in whatever was there."""
    return _change(table, corpora.withColumnRenamed("source_corpus", "__corpus"), lambda hit: {"source_corpus": F.when(hit, F.col("__corpus")).otherwise(F.col("source_corpus"))}, now)


def write_sections(table: DataFrame, contents: DataFrame, section: str, now: str) -> DataFrame:
    """Next state of papers with one section's contents (paper_hash, content), marked complete."""
    if section not in SECTION_COLUMNS:
        raise ValueError(f"no content column for section {section!r}")
    to = SECTION_COLUMNS[section]
    return _change(table, contents.withColumnRenamed("content", "__content"), lambda hit: {to: F.when(hit, F.col("__content")).otherwise(F.col(to)), "sections_completed": F.when(hit, _with(section)).otherwise(F.col("sections_completed"))}, now)


def mark_complete(table: DataFrame, keys: DataFrame, section: str, now: str) -> DataFrame:
    return _change(table, keys.select("paper_hash"), lambda hit: {"sections_completed": F.when(hit, _with(section)).otherwise(F.col("sections_completed"))}, now)


def _with(section: str) -> Column:
    done = F.coalesce("sections_completed", F.array().cast("array<string>"))
    return F.when(F.array_contains(done, section), done).otherwise(F.array_append(done, F.lit(section)))


def _change(table: DataFrame, rows: DataFrame, values, now: str) -> DataFrame:
    new = rows.withColumnRenamed("paper_hash", "__key")
    met = table.join(new, table["paper_hash"] == new["__key"], "left")
    hit = F.col("__key").isNotNull()
    changed = {"updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))} | values(hit)
    return met.select(*(changed.get(c, F.col(c)).alias(c) for c in table.columns))


def replace_diagrams(diagrams: DataFrame, parsed: DataFrame) -> DataFrame:
    """Next state of diagrams: papers in parsed (paper_hash, items array<struct<title, dot, svg>>) get new rows from 1."""
    kept = diagrams.join(parsed.select("paper_hash"), "paper_hash", "left_anti")
    new = parsed.select("paper_hash", F.posexplode("items").alias("at", "d")).select("paper_hash", (F.col("at") + 1).cast("int").alias("idx"), F.col("d.title").alias("title"), F.col("d.dot").alias("dot_src"), F.col("d.svg").alias("svg_content"))
    return kept.select("paper_hash", "idx", "title", "dot_src", "svg_content").unionByName(new)


def clear_section(papers: DataFrame, diagrams: DataFrame, section: str, now: str) -> tuple[DataFrame, DataFrame]:
    """Next states without a section, or without ``all`` of them; the corpus stays."""
    if section not in (*SECTIONS, "all"):
        raise ValueError(f"unknown section {section!r}")
    values = {"updated_at": F.lit(now), "sections_completed": F.array().cast("array<string>") if section == "all" else F.array_remove("sections_completed", section)}
    gone = list(SECTION_COLUMNS.values()) if section == "all" else [SECTION_COLUMNS[section]] if section in SECTION_COLUMNS else []
    if section in ("all", "diagrams"):
        gone.append("diagrams_raw")
        diagrams = diagrams.join(papers.select("paper_hash"), "paper_hash", "left_anti")
    values |= {c: F.lit(None).cast("string") for c in gone}
    return papers.select(*(values.get(c, F.col(c)).alias(c) for c in papers.columns)), diagrams


def replaced(rows: DataFrame, keys: DataFrame, key: str = "paper_hash") -> DataFrame:
    """rows as a delta that stands for all rows of keys: a key without any is marked gone."""
    gone = keys.select(key).distinct().join(rows.select(key), key, "left_anti").withColumn(GONE, F.lit(True))
    return rows.join(keys.select(key).distinct(), key, "left_semi").withColumn(GONE, F.lit(False)).unionByName(gone, allowMissingColumns=True)


def first_new(cache: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first of incoming rows of each key that the cache has not."""
    fresh = incoming.join(cache, keys, "left_anti")
    values = [c for c in cache.columns if c not in keys]
    return fresh.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("v")).select(*keys, "v.*").select(*cache.columns)


def put_first(cache: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Next state of a cache where the first write of a key stays."""
    return cache.unionByName(first_new(cache, incoming, keys, order))


def dangling(diagrams: DataFrame, papers: DataFrame) -> DataFrame:
    """Diagrams whose paper is gone."""
    return diagrams.join(papers, "paper_hash", "left_anti")


def changed_papers(papers: DataFrame, seen: DataFrame) -> DataFrame:
    """Papers whose hash the other side has not seen, in order of hash."""
    return papers.join(seen.select("paper_hash"), "paper_hash", "left_anti").orderBy("paper_hash")


def paper(papers: DataFrame, paper_hash: str) -> DataFrame:
    """The paper of a hash, or no row."""
    return papers.where(F.col("paper_hash") == paper_hash)


def paper_by_path(papers: DataFrame, path: str) -> DataFrame:
    """The newest paper at a path, or no row."""
    return latest(papers.where(F.col("pdf_path") == path), "pdf_path", F.desc("updated_at"), F.col("paper_hash"))


def diagrams_of(diagrams: DataFrame, paper_hash: str) -> DataFrame:
    return diagrams.where(F.col("paper_hash") == paper_hash).orderBy("idx")


def svg_of(diagrams: DataFrame, paper_hash: str, idx: int) -> DataFrame:
    """title, svg_content of a rendered diagram, or no row."""
    return diagrams.where((F.col("paper_hash") == paper_hash) & (F.col("idx") == idx) & F.col("svg_content").isNotNull()).select("title", "svg_content")


def with_diagrams(papers: DataFrame, diagrams: DataFrame) -> DataFrame:
    """Papers that have a corpus, each with its diagrams in order (an empty list for none)."""
    item = F.struct("idx", "title", "dot_src", "svg_content")
    own = diagrams.groupBy("paper_hash").agg(F.sort_array(F.collect_list(item)).alias("diagrams"))
    met = papers.where("source_corpus is not null").join(own, "paper_hash", "left")
    return met.withColumn("diagrams", F.coalesce("diagrams", F.array().cast("array<struct<idx:int,title:string,dot_src:string,svg_content:string>>")))


def write_raw_diagrams(table: DataFrame, raw: DataFrame, now: str) -> DataFrame:
    """Next state of papers with answers (paper_hash, raw) that held no diagram; the section stays open."""
    return _change(table, raw.select("paper_hash", F.col("raw").alias("__raw")), lambda hit: {"diagrams_raw": F.when(hit, F.col("__raw")).otherwise(F.col("diagrams_raw"))}, now)


def fenced(changes: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes (with write_id) split into those that ``leases.fenced_writes`` accepted and the others."""
    ok = judged.where("accepted").select("write_id")
    return changes.join(ok, "write_id", "left_semi"), changes.join(ok, "write_id", "left_anti")
