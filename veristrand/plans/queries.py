"""The registered queries over the driver's tables; each runs over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import PAPER_STATUSES
from ..functions import generated, text
from ..operators import chunks, evidence, graph, leases, pages, reports, store, synthesis
from ..schemas import BUNDLE, GRAPH_PAPERS, MAP_ANSWER, PAPERS
from ..session import compressed, cut_lineage, scratch_folder
from ..sources.answers import register
from ..sources.generator import missing_models as lacking
from ..sources.generator import stream_answer as read_stream
from ..sources.tables import Table
from ..streaming.leases import silence_stream
from ..streaming.papers import synced
from . import frames
from .oracles import ORACLES
from .paper_run import ask_chunks

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def long(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


def digest(c: str = "text") -> Column:
    return F.sha2(c, 256).alias("digest")


def joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


def hashed(c: str) -> Column:
    return F.sha2(F.col(c).cast("string"), 256)


# Pages


@query
def page_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.paper_pages(spark, sf_dir).select("paper", long("number"), F.length("text").cast("long").alias("chars"), digest())


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frames.paper_pages(spark, sf_dir)
    ocr = F.when(F.col("number") % 2 == 0, F.concat(F.lit("read "), "text")).otherwise(F.lit(""))
    cached = F.when(F.col("number") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("cached "), "text"))
    cache = p.where("number % 5 = 0").select("paper", (F.col("number") - 1).alias("page_idx"), cached.alias("text"))
    return pages.route_pages(p.withColumn("ocr", ocr), cache, budget=3)


@query
def page_ocr_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("paper", long("number"), "wants", "cached", "capped", "text", "method")


@query
def cache_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readers' texts of one page lie in the cache; only those of the profile at hand count."""
    p = frames.paper_pages(spark, sf_dir)
    texts = lambda name, every: p.where(F.col("number") % every == 0).select("paper", (F.col("number") - 1).alias("page_idx"), F.lit(name).alias("ocr_profile"), F.concat(F.lit(f"{name} "), "text").alias("text"))
    routed = pages.route_pages(p.withColumn("ocr", F.lit("")), texts("a", 5).unionByName(texts("b", 3)), mode="always", budget=0, profile="b")
    return routed.select("paper", long("number"), "cached", "text")


@query
def ocr_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _routed(spark, sf_dir)
    return r.groupBy("paper").agg(F.count_if(F.col("wants") & ~F.col("cached")).alias("fresh"), F.count_if("capped").alias("capped"))


@query
def ocr_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.ocr_stats(frames.papers(spark, sf_dir), _routed(spark, sf_dir)).withColumn("summary", pages.ocr_summary())


# Identity and routing


@query
def paper_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames.papers(spark, sf_dir).select("paper", F.sha2("text", 256).alias("paper_hash"))
    return d.withColumn("resource_key", F.concat(F.lit("sha256:"), "paper_hash"))


@query
def identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, r = F.sha2("text", 256), F.col("doc_id") % 4
    given = F.when(r == 0, h).when(r == 1, F.upper(h)).when(r == 2, F.substring(h, 1, 16))
    return frames.read(spark, sf_dir, "documents").select("doc_id", given.alias("paper_hash")).withColumn("valid", text.is_identity("paper_hash"))


@query
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames.papers(spark, sf_dir).select("paper", F.sha2("text", 256).alias("paper_hash"))
    return d.groupBy("paper_hash").agg(F.min("paper").alias("paper"), F.count(F.lit(1)).alias("copies"))


def _tiered(spark: SparkSession, sf_dir: str, override: Column | None) -> DataFrame:
    d = frames.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper"), "source", F.size(F.split("text", "\n")).alias("page_count"))
    return d.select("paper", long("page_count"), text.select_model(F.col("page_count"), override).alias("model"))


@query
def tier_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiered(spark, sf_dir, F.when(F.col("source") == "src0", F.lit("own-model")))


@query
def tier_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tier_order(_tiered(spark, sf_dir, None).select(F.col("paper").alias("path"), "model")).select("path", "model", long("ord"))


@query
def missing_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that documents are routed to and that the documents' sources, as a list of what there is, don't have."""
    wanted = _tiered(spark, sf_dir, F.when(F.col("source") == "src0", F.lit("src1")).when(F.col("source") == "src1", F.concat(F.lit("own-"), "source")))
    return lacking(wanted, frames.read(spark, sf_dir, "documents").select(F.col("source").alias("model")))


@query
def language_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames.read(spark, sf_dir, "documents")
    files = F.when(F.col("doc_id") % 4 > 0, F.create_map("lang", F.format_string("%d:%d", "n_chars", "doc_id"), F.lit("eng"), F.lit("7:8")))
    langs = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.concat_ws("+", "lang", F.lit("osd"), F.lit("eng")))
    return d.select("doc_id", text.language_fingerprint(langs, files).alias("fingerprint"))


# Chunks


@query
def fragment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = frames.papers(spark, sf_dir).select("paper", F.lit(1).alias("number"), "text", F.lit("native").alias("method"))
    return chunks.fragments(whole, 1064).select("paper", long("part"), F.length("text").cast("long").alias("chars"), digest())


@query
def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = chunks.fragments(frames.paper_pages(spark, sf_dir), 3000)
    m = chunks.chunk_fragments(f, chunks.chunk_bounds(f, char_cap=3000))
    return chunks.chunk_summary(m).select("paper", *map(long, ("chunk_index", "page_start", "page_end", "fragments", "chars")))


@query
def chunk_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.render(frames.members(spark, sf_dir)).select("paper", long("chunk_index"), digest("content"))


# Evidence


@query
def evidence_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.checked(spark, sf_dir).select("paper", long("chunk_index"), long("ord"), "kind", "support", long("page"), "accepted")


@query
def evidence_page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of which each names its pages as JSON has them: by page number mod 6 a number, one with a fraction, or a text, whole or not."""
    m = frames.written(spark, sf_dir)
    n = F.col("number").cast("string")
    given = [n, F.concat(n, F.lit(".9")), *(F.concat(F.lit('"'), x, F.lit('"')) for x in (n, F.concat(n, F.lit(".9")), F.concat(n, F.lit(".0")), F.concat(F.lit(" "), n, F.lit(" "))))]
    page = F.parse_json(F.get(F.array(*given), F.col("number") % 6))
    fact = F.struct("number", F.struct(F.lit("method").alias("kind"), F.lit("said").alias("statement"), F.substring("text", 1, 60).alias("support"), page.alias("page")).alias("e"))
    told = m.where("part = 0").groupBy("paper", "chunk_index").agg(F.transform(F.array_sort(F.collect_list(fact), lambda a, b: a["number"] - b["number"]), lambda x: x["e"]).alias("evidence"))
    answer = F.to_json(F.struct(F.lit("a chunk").alias("chunk_summary"), "evidence"))
    read = told.select("paper", "chunk_index", F.from_json(answer, MAP_ANSWER).alias("a"))
    said = read.select("paper", "chunk_index", F.posexplode("a.evidence").alias("ord", "e")).select("paper", "chunk_index", "ord", "e.kind", "e.statement", "e.support", "e.page")
    return evidence.check_proposals(said, chunks.chunk_pages(m)).select("paper", long("chunk_index"), long("ord"), long("page"), "accepted")


@query
def chunk_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each chunk after answers that can't be read or verified are asked again."""
    found = compressed(frames.members(spark, sf_dir))
    held = chunks.chunk_pages(found)
    judged, _ = ask_chunks(frames.asked(held, found), held, frames.stubborn)
    return judged.select("paper", long("chunk_index"), "error", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("accepted_items", "rejected_items")))


@query
def evidence_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.rejected_counts(frames.checked(spark, sf_dir)).withColumn("chunk_index", long("chunk_index"))


@query
def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.with_ids(frames.checked(spark, sf_dir)).select("paper", "evidence_id", "kind", "support", long("page"))


@query
def evidence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.items(spark, sf_dir).select("paper", "evidence_id", "kind", "support", long("page"))


@query
def evidence_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.items(spark, sf_dir).groupBy("paper", "kind").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("page").alias("pages"))


@query
def kind_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.remainder_order(frames.items(spark, sf_dir), "logic").select("paper", "evidence_id", long("ord"))


# Synthesis


def _chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_summary(frames.members(spark, sf_dir))


@query
def coverage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = synthesis.coverage_order(_chunk_pages(spark, sf_dir), ["paper"], ["page_start", "page_end"], "chunk_index")
    return c.select("paper", long("chunk_index"), long("ord"))


@query
def reduce_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = synthesis.groups_of(_chunk_pages(spark, sf_dir), "chunk_index").groupBy("paper", "grp")
    return g.agg(F.min("page_start").cast("long").alias("page_start"), F.max("page_end").cast("long").alias("page_end"), F.count(F.lit(1)).alias("children")).withColumn("grp", long("grp"))


@query
def reduce_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunk_pages(spark, sf_dir).groupBy("paper").agg(F.count(F.lit(1)).alias("chunks"))
    return c.select("paper", "chunks", synthesis.levels_of(F.col("chunks")).cast("long").alias("levels"))


def _leaves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaf dossiers, their items, and the chunks; members and items are written once."""
    found = frames.written(spark, sf_dir)
    items = cut_lineage(frames.items(spark, sf_dir, found))  # read by every level and by the contexts
    about = cut_lineage(chunks.chunk_summary(found))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("ord", "evidence_id"))), lambda x: x["evidence_id"])
    own = items.groupBy("paper", "chunk_index").agg(ids.alias("ids"))
    c = about.join(own, ["paper", "chunk_index"], "left")
    return c.select("paper", (F.col("chunk_index") - 1).alias("idx"), "page_start", "page_end", F.coalesce("ids", F.array().cast("array<string>")).alias("ids")), items, about


@query
def reduce_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves, items, _ = _leaves(spark, sf_dir)
    return synthesis.reduce_all(leaves, items, F.slice("available", 1, 4)).select("paper", long("page_start"), long("page_end"), joined("ids"), long("levels"))


@query
def relationship_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = synthesis.valid_relationships(frames.relations(frames.items(spark, sf_dir)))
    return r.select("paper", long("nth"), joined("ids"), "description")


@query
def context_prefix_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = frames.paper_pages(spark, sf_dir).select("paper", "number", F.length("text").alias("n"))
    kept = synthesis.prefix_fit(p, ["paper"], "number", F.col("n"), 1500)
    return kept.select("paper", long("number"), F.sum("n").over(Window.partitionBy("paper").orderBy("number")).alias("used"))


@query
def context_skip_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frames.papers(spark, sf_dir).select("paper", F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("number"), F.length(x).alias("n"))).alias("e"))
    kept = p.select("paper", synthesis.skip_fit(F.col("e"), lambda e: e["n"], 0, 1500).alias("kept")).where("size(kept) > 0")
    total = lambda f: F.aggregate("kept", F.lit(0).cast("long"), lambda a, e: a + e[f])
    return kept.select("paper", F.size("kept").cast("long").alias("entries"), total("number").alias("numbers"), total("n").alias("used"))


@query
def section_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded contexts of the section ``logic``: from lines of text to what a generator would read."""
    from ..operators.context import contexts

    leaves, items, about = _leaves(spark, sf_dir)
    root = cut_lineage(synthesis.reduce_all(leaves, items, F.slice("available", 1, 4)))
    n = frames.papers(spark, sf_dir).select("paper", F.size(F.split("text", "\n")).alias("page_count"))
    summary = F.concat(F.lit("pages "), "page_start", F.lit(" to "), "page_end")
    told = synthesis.valid_relationships(frames.relations(items))
    out = contexts(root.join(n, "paper").withColumn("summary", summary), about.withColumn("summary", summary), items, told, "logic", 6000)
    return out.select("paper", F.length("context").cast("long").alias("chars"), digest("context"), "error")


# Store


@query
def section_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.pending_sections(frames.stored(spark, sf_dir), "logic").select("paper_hash", "section", long("ord"))


@query
def missing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("sections_completed")
    return frames.stored(spark, sf_dir).select("paper_hash", store.is_complete(done).alias("complete"), F.array_join(store.missing_sections(done), ",").alias("missing"))


@query
def latest_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(frames.stored(spark, sf_dir), "pdf_path", F.desc("updated_at"), F.col("paper_hash")).select("pdf_path", "paper_hash", "updated_at")


def _full_papers(rows: DataFrame, **values: Column) -> DataFrame:
    return rows.select(*(values.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in PAPERS))


@query
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames.read(spark, sf_dir, "documents").select("doc_id", hashed("doc_id").alias("paper_hash"))
    name = lambda x: F.concat(F.lit(x), F.col("doc_id").cast("string"))
    old = F.lit("2024-01-01T00:00:00Z")
    table = _full_papers(d.where("doc_id % 3 <> 0"), paper_name=name("old-"), source_corpus=F.when(F.col("doc_id") % 2 == 0, "corpus"), created_at=old, updated_at=old)
    new = _full_papers(d.where("doc_id % 3 <> 1"), paper_name=name("new-"), source_corpus=F.lit("fresh"))
    return store.upsert_meta(table, new, "2024-02-01T00:00:00Z").select("paper_hash", "paper_name", "source_corpus", "created_at", "updated_at")


@query
def merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base and two deltas of documents, read as one state: the second names keys of the first again, and takes some away."""
    d = frames.read(spark, sf_dir, "documents").select(hashed("doc_id").alias("paper_hash"), "doc_id")
    told = lambda x: F.concat(F.lit(x), F.col("doc_id").cast("string")).alias("paper_name")
    delta = lambda rows, x, gone: rows.select("paper_hash", told(x), gone.alias(store.GONE))
    first = delta(d.where("doc_id % 5 in (1, 2)"), "first ", F.lit(False))
    second = delta(d.where("doc_id % 7 < 2"), "second ", F.col("doc_id") % 7 == 1)
    return store.merged(d.where("doc_id % 3 > 0").select("paper_hash", told("base ")), [first, second], ["paper_hash"])


@query
def commit_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each renewal tries to commit over the whole log's order, on a state up to 400 commits old."""
    e = frames.lease_events(spark, sf_dir).select("key", "event_id", "kind", F.col("event_id").alias("version"))
    tries = e.where("kind = 'renew'").select(F.col("event_id").alias("write_id"), "key", F.greatest(F.col("version") - 1 - F.col("event_id") % 400, F.lit(0)).alias("base"), F.col("version").alias("at"))
    return store.touched(tries, e.select("version", "key")).select("write_id", "conflict")


@query
def clear_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _full_papers(frames.stored(spark, sf_dir), summary_md=F.lit("summary text"), symbolic_logic_md=F.lit("logic text"), source_corpus=F.lit("corpus"))
    kept, _ = store.clear_section(table, spark.createDataFrame([], "paper_hash string"), "summary", "2024-02-01T00:00:00Z")
    return kept.select("paper_hash", joined("sections_completed"), "summary_md", "symbolic_logic_md", "source_corpus")


@query
def cache_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frames.paper_pages(spark, sf_dir).select("paper", F.col("number").alias("page_idx"), "text")
    tries = F.explode(F.array(F.struct(F.lit(2).alias("seq"), F.lit("second ").alias("word")), F.struct(F.lit(1).alias("seq"), F.lit("first ").alias("word"))))
    new = p.where("page_idx % 2 = 0").withColumn("t", tries).select("paper", "page_idx", F.concat("t.word", "text").alias("text"), F.col("t.seq").alias("seq"))
    return store.put_first(p.where("page_idx % 3 = 0"), new, ["paper", "page_idx"], "seq").select("paper", long("page_idx"), digest())


@query
def changed_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frames.stored(spark, sf_dir).select("paper_hash", "doc_id")
    return store.changed_papers(p, p.where("doc_id % 4 = 0"))


# Reports


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = frames.stored(spark, sf_dir)
    new = F.concat(F.lit("/papers/"), "source", F.lit("/new.pdf")).alias("pdf_path")
    files = known.select("pdf_path").distinct().union(frames.read(spark, sf_dir, "documents").select(new).distinct()).withColumn("content_hash", F.sha2("pdf_path", 256))
    live = known.where("doc_id % 7 = 0").select(F.concat(F.lit("sha256:"), "paper_hash").alias("resource_key"))
    return reports.paper_status(files, known, live)


@query
def paper_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).select("pdf_path", "status", joined("missing"), "in_progress")


@query
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.batch_progress(_status(spark, sf_dir))


@query
def entity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames.read(spark, sf_dir, "documents").select("doc_id")
    drawn = d.select(F.when(F.col("doc_id") % 4 != 0, "<svg/>").alias("svg_content"))
    return reports.entity_report(frames.stored(spark, sf_dir), drawn, frames.read(spark, sf_dir, "pages").select("page_id"), d.select((F.col("doc_id") % 7 == 0).alias("active")))


@query
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, PAPER_STATUSES)), (F.col("doc_id") % 5).cast("int"))
    return reports.status_histogram(frames.read(spark, sf_dir, "documents").select(status.alias("status"))).select(long("ord"), "status", "n")


# Leases


@query
def in_progress_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames.lease_events(spark, sf_dir)
    now = e.agg(F.max("ts")).first()[0] or 0.0
    rows = e.groupBy("key").agg(F.max("ts").alias("renewed_at"), (F.max_by("kind", F.struct("ts", "event_id")) != "release").alias("active"))
    return leases.in_progress(rows, now).select("key", "renewed_at")


@query
def lease_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.generations(frames.lease_events(spark, sf_dir))


@query
def lease_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.replay(frames.lease_events(spark, sf_dir)).select("key", "event_id", "kind", "accepted", "reclaimed", "holder", "now_generation", "renewed_at", "active")


@query
def fenced_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames.lease_events(spark, sf_dir)
    writes = e.where("kind = 'renew'").select("key", F.col("event_id").alias("write_id"), (F.col("ts") + 1).alias("ts"), "owner", "generation")
    return leases.fenced_writes(writes, leases.replay(e)).select("key", "write_id", "accepted")


@query
def heartbeat_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.lost_by_silence(frames.lease_events(spark, sf_dir))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query
def lease_silence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lost leases of the event log read as a stream: timers tell them, also after a key's last event."""
    events = frames.as_leases(frames.stream(spark, sf_dir, "events", 10_000))  # one batch: files of a table are in no order of time
    at, key = f"{scratch_folder(spark)}/silence-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        out = silence_stream(events.select("key", "ts"))
        out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, old)
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query
def synced_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream, merged into a stored table by identity: the first document of each and how many there were."""
    docs = frames.stream(spark, sf_dir, "documents")
    at = f"{scratch_folder(spark)}/synced-{uuid.uuid4().hex}"
    table = Table(spark, f"{at}/tables", "documents", T.StructType([T.StructField("paper_hash", T.StringType()), T.StructField("paper", T.LongType()), T.StructField("copies", T.LongType())]), ("paper_hash",))
    rows = docs.select(F.sha2("text", 256).alias("paper_hash"), F.col("doc_id").cast("long").alias("paper"), F.lit(1).cast("long").alias("copies"))
    merge = lambda own, new: own.unionByName(new).groupBy("paper_hash").agg(F.min("paper").alias("paper"), F.sum("copies").alias("copies"))
    synced(rows, table, merge).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return table.read()


@query
def answers_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as growing answers would be and read back by the data source, then joined to texts."""
    register(spark)
    c = frames.read(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.col("conv_id").cast("string").alias("request"), F.col("text").alias("response"), F.col("role").alias("thinking"), F.lit(False).alias("done")))
    at = f"{scratch_folder(spark)}/answers-{uuid.uuid4().hex}"
    said = c.where("conv_id is not null").repartition("conv_id").sortWithinPartitions("conv_id", "turn").select(line.alias("value"))
    said.write.text(at)
    lines = spark.read.format("answers").option("ending", ".txt").load(at)
    return read_stream(lines).select(F.col("request").cast("long").alias("request"), "text", long("thinking_chars"))


# Graph


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Evidence nodes and relation pairs, papers named by a digest."""
    items = cut_lineage(frames.items(spark, sf_dir))
    nodes = items.select(F.concat_ws(":", hashed("paper"), "evidence_id").alias("qid"), "paper", "evidence_id", "kind", "page")
    pairs = graph.relation_pairs(frames.relations(items).withColumn("paper_hash", hashed("paper")))
    return nodes, pairs


@query
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = F.struct("chunk_index", "ord", "evidence_id", "kind", "statement", "support", "page")
    facts = frames.items(spark, sf_dir).groupBy(hashed("paper").alias("paper_hash")).agg(F.sort_array(F.collect_list(fact)).alias("evidence"))
    bundle = F.struct(F.array(F.struct("evidence")).alias("chunks"))
    return graph.evidence_nodes(facts.select("paper_hash", bundle.alias("bundle"))).select("qid", "paper_hash", "evidence_id", "kind", long("page"))


@query
def relationship_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _graph(spark, sf_dir)[1].groupBy("paper_hash", "a", "b").agg(F.max_by("description", "seq").alias("description"))
    return last.select(F.concat_ws(":", "paper_hash", "a").alias("src"), F.concat_ws(":", "paper_hash", "b").alias("dst"), "description")


@query
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, pairs = _graph(spark, sf_dir)
    return graph.relates_to(pairs, nodes).select("src", "dst", "description")


@query
def graph_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, pairs = _graph(spark, sf_dir)
    return graph.connected_nodes(nodes.select(F.col("qid").alias("id"), F.col("evidence_id").alias("label")), graph.relates_to(pairs, nodes))


def _two_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored papers before and after: a sixth each is gone, renamed or new in the second."""
    p = cut_lineage(_bundles(spark, sf_dir).withColumn("paper_name", F.concat(F.lit("paper "), F.col("doc_id").cast("string"))))
    return p.where("doc_id % 6 <> 2"), p.where("doc_id % 6 <> 0").withColumn("paper_name", F.when(F.col("doc_id") % 6 == 1, "renamed").otherwise(F.col("paper_name")))


@query
def graph_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph brought from one state of the papers to the next by its changes alone: what changed, and each paper's nodes and edges after it."""
    before, after = _two_states(spark, sf_dir)
    drawn = lambda p: p.where("doc_id % 3 = 1").select("paper_hash", F.lit(1).alias("idx"), F.lit("t").alias("title"))
    seen = graph.graph_changes(before, drawn(before), spark.createDataFrame([], GRAPH_PAPERS))
    found = cut_lineage(graph.graph_changes(after, drawn(after), seen.select("paper_hash", "digest")))
    there = after.join(found.select("paper_hash"), "paper_hash", "left_semi")
    old, new = graph.owned_graph(before, drawn(before)), graph.owned_graph(there, drawn(there))
    nodes, edges = (cut_lineage(store.merged(a, [cut_lineage(store.replaced(cut_lineage(b), found))], ["paper_hash"])) for a, b in zip(old, new, strict=True))
    many = lambda rows, name: rows.groupBy("paper_hash").agg(F.count(F.lit(1)).alias(name))
    named = nodes.where("type = 'Paper'").select("paper_hash", "label").join(many(nodes, "nodes"), "paper_hash").join(many(edges, "edges"), "paper_hash", "left")
    return named.join(found.select("paper_hash", "change"), "paper_hash", "full").select("paper_hash", "change", "label", "nodes", "edges")


# Texts


@query
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalise("text"), 256).alias("digest"))


@query
def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.format_string("schema=1|dpi=%d|lang=%s|tess=none|pymupdf=1|td=x", "n_chars", "lang")
    profile = text.ocr_profile(F.col("n_chars"), F.col("lang"), F.lit("none"), F.lit("1"), F.lit("x"))
    return frames.read(spark, sf_dir, "documents").select(
        "doc_id", parts.alias("profile_parts"), profile.alias("profile"), text.strategy(F.col("doc_id") % 9, F.col("doc_id") % 3, F.col("n_chars")).alias("strategy"),
        text.duration_text(F.col("n_chars")).alias("took"), text.section_markdown(F.lit("logic"), F.col("lang")).alias("section"),
    )


@query
def stream_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frames.read(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.col("text").alias("response"), F.col("role").alias("thinking"), F.lit(False).alias("done")))
    return read_stream(c.select(F.col("conv_id").alias("request"), F.col("turn").alias("seq"), line.alias("line"))).select("request", "text", long("thinking_chars"))


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with two diagrams, the first one's end marker misspelled, the second's missing."""
    one = F.concat(F.lit("intro ===DIAGRAM_START: First "), "lang", F.lit("===\ndigraph g"), F.col("doc_id").cast("string"), F.lit(" { a -> b }\n===DIARGAM_END===\n"))
    return frames.read(spark, sf_dir, "documents").select("doc_id", F.concat(one, F.lit("===diagram_start: Second===\ngraph { c -- d }\n")).alias("raw"))


@query
def diagram_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _drawn(spark, sf_dir).select("doc_id", F.posexplode(generated.diagrams("raw")).alias("at", "d"))
    return d.select("doc_id", (F.col("at") + 1).cast("long").alias("idx"), "d.title", "d.dot")


@query
def diagram_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _drawn(spark, sf_dir).select("doc_id", F.explode(generated.diagrams("raw")).alias("d"))
    return d.select("doc_id", "d.title", generated.with_style("d.dot").alias("dot"))


@query
def dot_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.lit("A [\"label='"), "lang", F.lit(" \\n \"x\"'\"]; B [\"label='y']; C [label=\"z\"];"))
    return frames.read(spark, sf_dir, "documents").select("doc_id", generated.repair_labels(broken).alias("dot"))


@query
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('Sure: ```json\n{"chunk_summary": "'), "lang", F.lit(' \\dot{u} \\u0041", "evidence": []}\n```'))
    d = frames.read(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return d.select("doc_id", generated.json_object("raw", MAP_ANSWER)["chunk_summary"].alias("summary"), generated.first_json_object("raw").alias("object"))




# Bundles, lookups, remaining formats


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle for each document: by doc_id % 5 sound, of another version, model, kind, or with an unknown id at its root."""
    r = F.col("doc_id") % 5
    fact = lambda i: F.struct(F.lit(f"C001-E00{i}").alias("evidence_id"), F.lit(1).alias("chunk_index"), F.when(r == 3, "guess").otherwise("method").alias("kind"), F.lit("s").alias("statement"), F.lit("q").alias("support"), F.lit(1).alias("page"))
    chunk = F.struct(F.lit(1).alias("chunk_index"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("x").alias("summary"), F.array(fact(1), fact(2)).alias("evidence"), F.lit(0).alias("rejected_items"))
    one = F.struct(F.array(*map(F.lit, ("C001-E001", "C001-E002", "C001-E003"))).alias("evidence_ids"), F.lit("d").alias("description"))
    told = F.array_repeat(one, (F.col("doc_id") % 4).cast("int"))
    root = F.struct(F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("x").alias("summary"), F.array(F.when(r == 4, "C009-E001").otherwise("C001-E002")).alias("selected_evidence_ids"), told.alias("relationships"))
    bundle = F.struct(F.when(r == 1, 2).otherwise(1).alias("schema_version"), F.col("paper_hash"), F.when(r == 2, "other").otherwise("m").alias("model"), F.lit(1).alias("physical_page_count"), F.array(chunk).alias("chunks"), root.alias("root"), F.lit(0).alias("reduction_levels"))
    corpus = F.when(F.col("doc_id") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(bundle.cast(BUNDLE)))
    d = frames.read(spark, sf_dir, "documents").select("doc_id", hashed("doc_id").alias("paper_hash"))
    return d.select("doc_id", "paper_hash", F.lit("m").alias("model_used"), corpus.alias("source_corpus"))


@query
def bundle_reusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.bundles import reusable

    return reusable(_bundles(spark, sf_dir)).select("doc_id", "reusable")


@query
def import_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.import_totals(graph.parsed(_bundles(spark, sf_dir)))


@query
def papers_with_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _bundles(spark, sf_dir)
    drawn = p.where("doc_id % 3 > 0").select("paper_hash", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3).cast("int"))).alias("idx"), F.lit("t").alias("title"), F.lit("d").alias("dot_src"), F.lit(None).cast("string").alias("svg_content"))
    return store.with_diagrams(p, drawn).select("paper_hash", F.array_join(F.transform("diagrams", lambda d: d["idx"].cast("string")), ",").alias("diagrams"))


@query
def incomplete_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.stored(spark, sf_dir).where(~store.is_complete(F.col("sections_completed"))).select("paper_hash")


@query
def owned_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases that their last claimant still holds an hour after the log's end."""
    log = leases.replay(frames.lease_events(spark, sf_dir))
    now = log.agg(F.max("ts")).first()[0] or 0.0
    last = log.groupBy("key").agg(F.max_by(F.struct("holder", "now_generation", "renewed_at", "active"), F.struct("ts", "event_id")).alias("s"))
    rows = last.select("key", F.col("s.holder").alias("owner_id"), F.col("s.now_generation").alias("generation"), F.col("s.renewed_at").alias("renewed_at"), F.col("s.active").alias("active"))
    return rows.select("key", F.coalesce(leases.is_current(F.lit("own"), F.col("generation"), F.lit(now + 3600)), F.lit(False)).alias("owned"))


@query
def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("folder/"), F.repeat(F.lit("p"), (F.col("doc_id") % 70).cast("int")), F.lit(".pdf"))
    n = F.col("n_chars") * 1000
    d = frames.read(spark, sf_dir, "documents")
    code = F.coalesce(F.when(F.col("source") == "src1", "coder"), text.select_model(F.lit(1)))
    prompt = text.template("Write {section} of {lang}: {section}.", section=F.lit("logic"), lang=F.col("lang"))
    return d.select("doc_id", text.display_path(path).alias("path"), text.bytes_text(n).alias("bytes"), code.alias("code_model"), prompt.alias("prompt"))
