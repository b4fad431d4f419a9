"""A folder of documents into the stored tables: incremental, resumable, fenced."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import HEARTBEAT_S, LEASE_STALE_S, OCR_BUDGET, SECTIONS
from ..functions.text import select_model, strategy
from ..operators import bundles, leases, pages, reports, store
from ..schemas import BUNDLE, OCR_CACHE
from ..session import cut_lineage
from ..sources import migrations
from ..sources.files import content_hash, list_files
from ..sources.generator import Generator, check_models
from ..sources.tables import Reads, Table, check_identities, update
from . import paper_run

#: Instructions of the sections; callers may bring their own.
PROMPTS = {
    "summary": "Write a summary of the evidence below, with what motivates it, its methods, results and limits.",
    "logic": "State the definitions, equations and algorithms of the evidence below in symbolic form.",
    "cpp": "Write C++ examples of the algorithms in the evidence below.",
    "diagrams": "Draw Graphviz diagrams of the evidence below. Put ===DIAGRAM_START: title=== before and ===DIAGRAM_END=== behind each.",
    "extras": "Write a critical analysis of the evidence below.",
}


def text_pages(raw: bytes) -> list[str]:
    """Pages of a text file: form feeds part them."""
    return raw.decode("utf-8", "replace").split("\f")


class Tables:
    """The four stored tables below one root folder; tables of an older layout are brought up to date first."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        migrations.migrate_root(spark, root)
        check = lambda name: None if name == "processing_leases" else check_identities
        of = lambda name: Table(spark, root, name, migrations.SCHEMAS[name], migrations.KEYS[name], check=check(name))
        self.papers, self.diagrams, self.ocr_cache, self.leases = map(of, ("papers", "diagrams", "ocr_cache", "processing_leases"))
        self.commits = self.papers.commits


def _some(rows: DataFrame) -> list[DataFrame] | None:
    """rows as a delta, None where there are none: then nothing is committed."""
    rows = cut_lineage(rows)
    return None if rows.isEmpty() else [rows]


def claim(tables: Tables, keys: DataFrame, owner: str, now: float, stale: float = LEASE_STALE_S) -> DataFrame:
    """Claim keys (resource_key) for owner; the rows of those granted, with their generation.

    A key is refused while another claim on it is active and fresh. Of two claimants of a key
    at once one commits first; the other judges anew on what it finds then.
    """
    if stale <= 0:
        raise ValueError("a lease needs a positive time to live")
    asked = cut_lineage(keys.select("resource_key").distinct())
    got: list[DataFrame] = []

    def change(version: int) -> list[DataFrame] | None:
        met = asked.join(tables.leases.rows_of(asked, version), "resource_key", "left")
        free = met.where(~F.coalesce(F.col("active") & (F.lit(now) - F.col("renewed_at") < stale), F.lit(False)))
        granted = free.select("resource_key", F.lit(owner).alias("owner_id"), (F.coalesce("generation", F.lit(0)) + 1).cast("long").alias("generation"), F.lit(float(now)).alias("renewed_at"), F.lit(True).alias("active"))
        some = _some(granted)
        got[:] = some or [granted.where("false")]
        return some

    update([tables.leases], change)
    return got[0]


def _own(granted: DataFrame) -> DataFrame:
    return granted.select("resource_key", F.col("owner_id").alias("o"), F.col("generation").alias("g"))


def release(tables: Tables, granted: DataFrame) -> None:
    """Set granted leases inactive, where owner and generation still match."""

    def change(version: int) -> list[DataFrame] | None:
        met = tables.leases.rows_of(granted, version).join(_own(granted), "resource_key")
        own = met.where(F.col("active") & (F.col("owner_id") == F.col("o")) & (F.col("generation") == F.col("g")))
        return _some(own.withColumn("active", F.lit(False)).drop("o", "g"))

    update([tables.leases], change)


def renew(tables: Tables, granted: DataFrame, now: float, stale: float = LEASE_STALE_S) -> None:
    """Renew granted leases that are still held; lost and stale ones stay as they are."""

    def change(version: int) -> list[DataFrame] | None:
        met = tables.leases.rows_of(granted, version).join(_own(granted), "resource_key")
        own = met.where(leases.is_current(F.col("o"), F.col("g"), F.lit(now), stale))
        return _some(own.withColumn("renewed_at", F.lit(float(now))).drop("o", "g"))

    update([tables.leases], change)


def still_held(tables: Tables, granted: DataFrame, now: float, stale: float = LEASE_STALE_S, version: int | None = None) -> DataFrame:
    """paper_hash of the granted leases that are current: what a write at now may touch."""
    met = tables.leases.rows_of(granted, version).join(_own(granted), "resource_key").where(leases.is_current(F.col("o"), F.col("g"), F.lit(now), stale))
    return met.select(F.regexp_replace("resource_key", "^sha256:", "").alias("paper_hash"))


class LeaseLost(RuntimeError):
    """No lease of the batch is held any more, or renewal has failed for half its time to live."""


class Interrupted(RuntimeError):
    """The batch was asked to stop."""


class Heartbeat:
    """Renews a batch's leases in a thread of its own, beside the jobs that work under them."""

    def __init__(self, tables: Tables, granted: DataFrame, clock: Callable[[], float], interval: float = HEARTBEAT_S, stale: float = LEASE_STALE_S):
        if interval <= 0 or stale <= 0:
            raise ValueError("heartbeat and time to live must be positive")
        if interval >= stale / 2:
            raise ValueError("a heartbeat must come more than twice in a lease's time to live")
        self.tables, self.granted, self.clock, self.interval, self.stale = tables, granted, clock, interval, stale
        self.renewed_at, self.error = clock(), None
        self._stop, self._one = threading.Event(), threading.Lock()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def __enter__(self) -> Heartbeat:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.stop()

    def stop(self) -> None:
        self._stop.set()
        if self._thread.is_alive():
            self._thread.join()

    def beat(self) -> None:
        with self._one:
            try:
                now = self.clock()
                renew(self.tables, self.granted, now, self.stale)
                self.renewed_at, self.error = now, None
            except Exception as e:  # judged by held()
                self.error = f"{type(e).__name__}: {e}"

    def _run(self) -> None:
        while not self._stop.wait(self.interval):
            self.beat()

    def held(self) -> DataFrame:
        """paper_hash of what the batch may go on with, renewed now. Raises where that is nothing."""
        self.beat()
        if self.error and self.clock() - self.renewed_at >= self.stale / 2:
            raise LeaseLost(f"renewal has failed since {self.renewed_at}: {self.error}")
        own = cut_lineage(still_held(self.tables, self.granted, self.clock(), self.stale))
        if own.isEmpty():
            raise LeaseLost("every lease of the batch is lost")
        return own


@dataclass
class Ocr:
    """How pages with little text are read: by read (content, page from 0) -> text, under a profile that names the reader's settings."""

    read: Callable[[bytes, int], str] | None = None
    profile: str = ""
    mode: str = "auto"
    budget: int = OCR_BUDGET


def page_texts(tables: Tables, files: DataFrame, ocr: Ocr) -> tuple[DataFrame, DataFrame]:
    """Routed pages of files (paper, pages, content), and what was read afresh as rows of the cache.

    The cache counts under its reader's profile only. Pages are routed once to find those to
    be read; a failed page reads as empty.
    """
    raw = files.select("paper", F.posexplode("pages").alias("at", "text")).select("paper", (F.col("at") + 1).alias("number"), "text")
    cache = tables.ocr_cache.read().withColumnRenamed("paper_hash", "paper")
    how = {"profile": ocr.profile, "mode": ocr.mode, "available": ocr.read is not None, "budget": ocr.budget}
    none = F.lit(None).cast("string")
    first = cut_lineage(pages.route_pages(raw.withColumn("ocr", none), cache, **how))
    wanted = first.where("wants and not cached and not capped").groupBy("paper").agg(F.sort_array(F.collect_list("number")).alias("numbers"))
    read = ocr.read

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def texts(content: pd.Series, numbers: pd.Series) -> pd.Series:
        def safe(raw: bytes, at: int) -> str:
            try:
                return read(raw, at) or ""
            except Exception:  # a page that can't be read is an empty one
                return ""

        return pd.Series([[safe(bytes(c), int(n) - 1) for n in ns] for c, ns in zip(content, numbers, strict=True)])

    if read is None:
        return first, tables.spark.createDataFrame([], OCR_CACHE)
    told = files.join(wanted, "paper").select("paper", F.explode(F.arrays_zip("numbers", texts("content", "numbers").alias("texts"))).alias("x"))
    told = cut_lineage(told.select("paper", F.col("x.numbers").alias("number"), F.col("x.texts").alias("ocr")))
    routed = cut_lineage(pages.route_pages(raw.join(told, ["paper", "number"], "left"), cache, **how))
    fresh = told.select(F.col("paper").alias("paper_hash"), (F.col("number") - 1).alias("page_idx"), F.lit(ocr.profile).alias("ocr_profile"), F.col("ocr").alias("text"))
    return routed, fresh


def run_batch(
    tables: Tables, root: str, generator: Generator, clock: Callable[[], float], owner: str = "batch", pattern: str = "*.txt", reader: Callable[[bytes], list[str]] = text_pages,
    prompts: dict[str, str] = PROMPTS, model: str | None = None, code_model: str | None = None, reprocess: str | None = None,
    ocr: Ocr | None = None, render: Callable[[str], str | None] | None = None, only: str | None = None, interval: float = HEARTBEAT_S, stale: float = LEASE_STALE_S,
    stop: Callable[[], bool] = lambda: False, found: DataFrame | None = None,
) -> DataFrame:
    """Process every document below root that is not complete; paper_hash and status of each.

    clock gives epoch seconds; only names one file; found (path, content) are files at hand in
    place of those below root. stop is asked before each step: where it says so, what is not
    committed is INTERRUPTED and its leases are released. Same bytes are one paper. Evidence of a
    former run is taken from its bundle where that may be reused, so a resumed paper only
    writes what is missing. Leases are renewed beside the work and judged before each step:
    papers lost meanwhile are worked on no further. Papers, diagrams and cached page texts are
    committed in one step that writes the batch's own rows alone and rests on its leases, so
    other batches' commits don't stand in its way. A paper whose evidence or
    reduction fails is FAILED and nothing of it is stored but its cached pages. Where the
    generator lacks a model that papers ask for, ModelsMissing is raised before any prompt.
    """
    if reprocess not in (None, "all", *SECTIONS):
        raise ValueError(f"unknown section {reprocess!r}")
    spark, now, ocr = tables.spark, clock(), ocr or Ocr()
    stamp = pd.Timestamp(now, unit="s", tz="UTC").strftime("%Y-%m-%dT%H:%M:%SZ")
    known = cut_lineage(tables.papers.read())
    files = (list_files(spark, root, pattern) if found is None else found).select("path", content_hash().alias("paper_hash"), "content")
    if only:
        files = files.where(F.element_at(F.split("path", "/"), -1) == only)
    first = files.groupBy("paper_hash").agg(F.min_by(F.struct("path", "content"), "path").alias("f")).select("paper_hash", "f.path", "f.content")
    done = known.where(store.is_complete(F.col("sections_completed"))).select("paper_hash")
    todo = first if reprocess else first.join(done, "paper_hash", "left_anti")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(content: pd.Series) -> pd.Series:
        return content.map(lambda raw: reader(bytes(raw)))

    todo = cut_lineage(todo.select("paper_hash", "path", "content", split("content").alias("pages")))
    granted = claim(tables, todo.select(F.concat(F.lit("sha256:"), "paper_hash").alias("resource_key")), owner, now, stale)
    mine = granted.select(F.regexp_replace("resource_key", "^sha256:", "").alias("paper_hash"))
    work = cut_lineage(todo.join(mine, "paper_hash", "left_semi"))
    none = work.select("paper_hash").where("false")
    own, failed, state, stopped = none, none, known, none
    beat = Heartbeat(tables, granted, clock, interval, stale)

    def go_on() -> None:
        if stop():
            raise Interrupted

    try:
        if not work.isEmpty():
            with beat:
                go_on()
                routed, fresh_pages = page_texts(tables, work.select(F.col("paper_hash").alias("paper"), "pages", "content"), ocr)
                go_on()
                own = beat.held()
                count = F.size("pages")
                papers = work.join(own, "paper_hash", "left_semi").join(known.select("paper_hash", "sections_completed", "source_corpus", "model_used"), "paper_hash", "left").select(
                    F.col("paper_hash").alias("paper"), "paper_hash", "path", count.alias("page_count"), select_model(count, F.lit(model)).alias("model"), F.lit(code_model).cast("string").alias("code_model"),
                    F.coalesce("sections_completed", F.array().cast("array<string>")).alias("sections_completed"), "source_corpus", "model_used",
                )
                papers = cut_lineage(papers)
                check_models(papers.select("model").union(papers.select("code_model")), generator)
                fresh = papers if reprocess == "all" else papers.join(bundles.reusable(papers.withColumn("model_used", F.col("model"))).where("reusable").select("paper_hash"), "paper_hash", "left_anti")
                read = paper_run.extract(pages.extracted(routed).join(fresh.select("paper"), "paper", "left_semi"), fresh.select("paper", "model"), generator)
                failed = cut_lineage(read.failed.select(F.col("paper").alias("paper_hash")).distinct())
                made = cut_lineage(paper_run.corpora(read, fresh))
                kept = papers.join(fresh.select("paper"), "paper", "left_anti").select("paper_hash", "source_corpus")
                go_on()
                own = beat.held()  # before sections are written: lost papers cost no further answer
                good = cut_lineage(papers.join(failed, "paper_hash", "left_anti").join(own, "paper_hash", "left_semi"))
                corpora = cut_lineage(made.unionByName(kept).join(good.select("paper_hash"), "paper_hash", "left_semi"))
                loaded = paper_run.load(corpora.join(good.drop("source_corpus"), "paper_hash"))
                answers = cut_lineage(paper_run.write_up(loaded, good, generator, prompts, reprocess))
                go_on()
                beat.held()
            own, state = _commit(tables, granted, good, corpora, answers, fresh_pages, stamp, clock, stale, render)
    except LeaseLost:
        own = none
    except Interrupted:
        stopped = work.select("paper_hash")
    finally:
        beat.stop()
        release(tables, granted)
    ended = first.select("paper_hash").join(state.select("paper_hash", "sections_completed"), "paper_hash", "left").join(todo.select("paper_hash", F.lit(1).alias("todo")), "paper_hash", "left").join(own.withColumn("own", F.lit(1)), "paper_hash", "left").join(failed.withColumn("failed", F.lit(1)), "paper_hash", "left").join(stopped.withColumn("stopped", F.lit(1)), "paper_hash", "left")
    status = F.when(F.col("todo").isNull(), "ALREADY_COMPLETE").when(F.col("stopped").isNotNull(), "INTERRUPTED").when(F.col("failed").isNotNull(), "FAILED").when(F.col("own").isNull(), "CLAIMED_ELSEWHERE").when(store.is_complete(F.col("sections_completed")), "COMPLETE").otherwise("PARTIAL")
    return cut_lineage(ended.select("paper_hash", status.alias("status")))


def _commit(tables: Tables, granted: DataFrame, papers: DataFrame, corpora: DataFrame, answers: DataFrame, read: DataFrame, stamp: str, clock: Callable[[], float], stale: float, render) -> tuple[DataFrame, DataFrame]:
    """One commit of papers, diagrams and cached texts that rests on the leases they are judged by; what is held, and its papers' state.

    It is written anew only if a paper's lease is lost meanwhile, or one of its rows was written.
    """
    out: list[DataFrame] = []

    def held(version: int) -> bool:
        return out[0].join(still_held(tables, granted, clock(), stale, version), "paper_hash", "left_anti").isEmpty()

    def change(version: int) -> list[DataFrame]:
        own = cut_lineage(still_held(tables, granted, clock(), stale, version))
        state, drawn = (t.rows_of(own, version) for t in (tables.papers, tables.diagrams))
        b = F.from_json("source_corpus", BUNDLE)
        told = corpora.select("paper_hash", strategy(F.size(b["chunks"]), b["reduction_levels"], F.size(F.flatten(F.transform(b["chunks"], lambda c: c["evidence"])))).alias("strategy"))
        meta = papers.join(own, "paper_hash", "left_semi").join(told, "paper_hash", "left").select(
            "paper_hash", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("paper_name"), F.col("path").alias("pdf_path"), "page_count", F.col("model").alias("model_used"), F.col("code_model").alias("code_model_used"),
            "strategy", F.lit(stamp).alias("processed_at"), F.lit(None).cast("string").alias("source_corpus"),
        )
        state = store.write_corpus(store.upsert_meta(state, meta, stamp), corpora.join(own, "paper_hash", "left_semi"), stamp)
        state, drawn = paper_run.store_answers(state, drawn, answers.join(own, "paper_hash", "left_semi"), stamp, render)
        state = cut_lineage(state)
        keys = ["paper_hash", "page_idx", "ocr_profile"]
        out[:] = [own, state]
        return [state, store.replaced(drawn, own), store.first_new(tables.ocr_cache.read(version), read.withColumn("seq", F.lit(0)), keys, "seq")]

    leased = Reads(tables.leases, granted.select("resource_key"), held)
    update([tables.papers, tables.diagrams, tables.ocr_cache], change, (leased,))
    return out[0], out[1]


def clear(tables: Tables, section: str, now: float, paper_hash: str | None = None) -> None:
    """Forget a section, or ``all`` of them, of one paper or of every one, in one commit."""
    stamp = pd.Timestamp(now, unit="s", tz="UTC").strftime("%Y-%m-%dT%H:%M:%SZ")

    def change(version: int) -> list[DataFrame]:
        mine = F.lit(True) if paper_hash is None else F.col("paper_hash") == paper_hash
        state = tables.papers.read(version).where(mine)
        cleared, left = store.clear_section(state, tables.diagrams.read(version).where(mine), section, stamp)
        return [cleared, store.replaced(left, state.select("paper_hash"))]

    update([tables.papers, tables.diagrams], change)


def hashed_until(files: DataFrame, wanted: DataFrame, first: int = 64) -> DataFrame:
    """path, content_hash of files (path, content), until every hash of wanted (content_hash) is found.

    Files are dealt out by a hash of their path and read in rounds, about first of them and
    then four times as many each; none is read once nothing is left to find.
    """
    paths = cut_lineage(files.select("path", F.pmod(F.xxhash64("path"), F.lit(_SHARES)).alias("share")))
    total = paths.count()
    low, high = 0, max(1, -(-_SHARES * first // max(1, total)))
    out = cut_lineage(files.select("path", content_hash().alias("content_hash")).where("false"))
    left = cut_lineage(wanted.select("content_hash").distinct())
    while low < _SHARES and total and not left.isEmpty():
        round_ = paths.where((F.col("share") >= low) & (F.col("share") < high)).select("path")
        out = out.unionByName(cut_lineage(files.join(round_, "path", "left_semi").select("path", content_hash().alias("content_hash"))))
        left = cut_lineage(left.join(out, "content_hash", "left_anti"))
        low, high = high, high * 4
    return out


#: Shares that files are dealt to.
_SHARES = 4096


def status_of(tables: Tables, root: str, now: float, pattern: str = "*.txt") -> DataFrame:
    """Status of every document below root. Files that no paper knows are hashed only as far as live leases of unknown papers ask for it."""
    known, live = tables.papers.read(), leases.in_progress(tables.leases.read(), now)
    found = list_files(tables.spark, root, pattern)
    new = found.join(known.select(F.col("pdf_path").alias("path")).distinct(), "path", "left_anti").select("path", "content")
    by_path = known.join(found.select(F.col("path").alias("pdf_path")), "pdf_path", "left_semi").select(F.col("paper_hash").alias("content_hash"))
    asked = live.select(F.regexp_replace("resource_key", "^sha256:", "").alias("content_hash")).join(by_path, "content_hash", "left_anti")
    files = found.select("path").join(hashed_until(new, asked), "path", "left").select(F.col("path").alias("pdf_path"), "content_hash")
    return reports.paper_status(files, known, live)
