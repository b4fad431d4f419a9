"""python -m veristrand list|entities|graph|run|clear ...: the engine's tables from a shell."""

from __future__ import annotations

import argparse
import importlib
import os
import socket
import time
import uuid

from pyspark.sql import functions as F

from .constants import OCR_BUDGET, SECTIONS
from .operators import graph, reports, store
from .plans.batch import Ocr, Tables, clear, run_batch, status_of
from .plans.graph_sync import GraphTables, sync_graph
from .session import session

MARKS = {"complete": "+", "partial": "~", "not started": "-"}


def owner_id() -> str:
    """Host, process and a random part: containers that share the first two stay apart."""
    return f"{socket.gethostname()}:{os.getpid()}:{uuid.uuid4().hex}"


def resolved(path: str) -> str:
    """A local path with home and variables expanded, made absolute; one with a scheme as it is."""
    path = os.path.expandvars(os.path.expanduser(path))
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def loaded(name: str | None):
    """The object that module:name names."""
    if name is None:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veristrand", description=__doc__)
    p.add_argument("--tables", default=os.environ.get("VERISTRAND_TABLES", "~/.veristrand"), help="root folder of the stored tables")
    sub = p.add_subparsers(dest="command", required=True)
    listing = sub.add_parser("list")
    listing.add_argument("--no-sort", action="store_true", help="by path, not by model tier")
    run = sub.add_parser("run")
    for c in (listing, run):
        c.add_argument("folder")
        c.add_argument("--pattern", default="*.txt")
    run.add_argument("--generator", required=True, help="module:function of (model, prompt)")
    run.add_argument("--reader", help="module:function of (bytes) -> texts of its pages; by default form feeds part them")
    run.add_argument("--page-reader", help="module:function of (bytes, page from 0) -> text, for pages with little text")
    run.add_argument("--render", help="module:function of (DOT source) -> SVG")
    run.add_argument("--paper", help="process one file of the folder")
    run.add_argument("--workers", type=int, help="partitions that work side by side")
    run.add_argument("--model")
    run.add_argument("--code-model")
    run.add_argument("--reprocess", choices=[*SECTIONS, "all"])
    run.add_argument("--ocr", choices=["auto", "always", "never"], default="auto")
    run.add_argument("--ocr-profile", default="", help="names the page reader and its settings; cached texts count under it only")
    run.add_argument("--ocr-max-pages", type=int, default=OCR_BUDGET, help="pages read of one document, 0 for no limit")
    sub.add_parser("entities")
    sub.add_parser("graph").add_argument("out")
    wipe = sub.add_parser("clear")
    wipe.add_argument("section", choices=[*SECTIONS, "all"])
    wipe.add_argument("--hash", help="of one paper; by default every paper")
    a = p.parse_args(argv)
    tables = Tables(session(partitions=getattr(a, "workers", None)), resolved(a.tables))
    if a.command == "list":
        rows = status_of(tables, a.folder, time.time(), a.pattern)
        order = ["pdf_path"] if a.no_sort else [F.col("page_count").asc_nulls_last(), "pdf_path"]
        known = tables.papers.read().groupBy("pdf_path").agg(F.max("page_count").alias("page_count"))
        for r in rows.join(known, "pdf_path", "left").orderBy(*order).toLocalIterator():
            print(MARKS[r["status"]], "*" if r["in_progress"] else " ", r["pdf_path"], ", ".join(r["missing"]))
        print(reports.batch_progress(rows).first().asDict())
    elif a.command == "entities":
        for r in reports.entity_report(tables.papers.read(), tables.diagrams.read(), tables.ocr_cache.read(), tables.leases.read()).collect():
            print(f"{r['entity']:<18} {r['metric']:<9} {r['value']}")
    elif a.command == "graph":
        papers, kept = tables.papers.read(), GraphTables(tables.spark, resolved(f"{a.out}/tables"))
        sync_graph(kept, papers, tables.diagrams.read())
        nodes, edges = kept.read()
        graph.connected_nodes(nodes, edges).write.mode("overwrite").parquet(f"{a.out}/nodes")
        edges.write.mode("overwrite").parquet(f"{a.out}/edges")
        print(papers.where(F.col("source_corpus").isNotNull()).count(), "papers,", papers.where(store.is_complete(F.col("sections_completed"))).count(), "complete")
    elif a.command == "clear":
        clear(tables, a.section, time.time(), a.hash)
    else:
        more = {"reader": loaded(a.reader)} if a.reader else {}
        ocr = Ocr(loaded(a.page_reader), a.ocr_profile, a.ocr, a.ocr_max_pages)
        found = run_batch(tables, a.folder, loaded(a.generator), time.time, owner_id(), a.pattern, model=a.model, code_model=a.code_model, reprocess=a.reprocess, ocr=ocr, render=loaded(a.render), only=a.paper, **more)
        for r in reports.status_histogram(found).orderBy("ord").collect():
            print(f"{r['status']:<18} {r['n']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
