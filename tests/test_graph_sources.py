import json

import pytest

from veristrand.operators import graph
from veristrand.schemas import BUNDLE, DIAGRAMS
from veristrand.sources import files, generator

A, B = "a" * 64, "b" * 64


def bundle(paper, relations):
    item = {"evidence_id": "C001-E001", "chunk_index": 1, "kind": "method", "statement": "s" * 600, "support": "q", "page": 1}
    root = {"page_start": 1, "page_end": 1, "summary": "x", "selected_evidence_ids": [], "relationships": relations}
    chunk = {"chunk_index": 1, "page_start": 1, "page_end": 1, "summary": "x", "evidence": [item, item | {"evidence_id": "C001-E002"}, item | {"evidence_id": "C001-E003"}], "rejected_items": 0}
    return json.dumps({"schema_version": 1, "paper_hash": paper, "model": "m", "physical_page_count": 1, "chunks": [chunk], "root": root, "reduction_levels": 0})


@pytest.fixture(scope="module")
def parts(spark):
    three = {"evidence_ids": ["C001-E001", "C001-E002", "C001-E003"], "description": "first"}
    again = {"evidence_ids": ["C001-E001", "C001-E002"], "description": "last"}
    gone = {"evidence_ids": ["C001-E001", "C009-E001"], "description": "no such node"}
    rows = [(A, "one", "m", 1, bundle(A, [three, again, gone])), (B, None, "m", 1, bundle(B, [])), ("c" * 64, "bad", "m", 1, "{broken"), ("d" * 64, "none", "m", 1, None)]
    papers = spark.createDataFrame(rows, "paper_hash string, paper_name string, model_used string, page_count int, source_corpus string")
    drawn = spark.createDataFrame([(A, 1, "t", "d", "svg"), ("c" * 64, 1, "t", "d", None)], DIAGRAMS)
    return papers, drawn


def test_graph(spark, parts):
    nodes, edges = graph.graph(*parts)
    assert {(r["type"], r["count"]) for r in nodes.groupBy("type").count().collect()} == {("Paper", 2), ("Evidence", 6), ("Diagram", 1)}
    assert nodes.where(f"id = '{B}'").first()["label"] == B
    related = {(r["src"][-4:], r["dst"][-4:], r["description"]) for r in edges.where("type = 'RELATES_TO'").collect()}
    assert related == {("E001", "E002", "last"), ("E001", "E003", "first"), ("E002", "E003", "first")}
    assert edges.count() == 6 + 1 + 3
    facts = graph.evidence_nodes(graph.parsed(parts[0]))
    assert facts.select("qid").distinct().count() == 6 and len(facts.first()["statement"]) == 500


def test_endpoints(spark, parts):
    nodes, edges = graph.graph(*parts)
    lone = spark.createDataFrame([("x", "Paper", "x")], nodes.schema)
    assert graph.connected_nodes(nodes.union(lone), edges).count() == nodes.count()
    assert graph.connected_nodes(lone, edges.where("false")).count() == 1


def test_bundle_round_trip(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(bundle(A, []),)], "x string").select(F.from_json("x", BUNDLE).alias("b"))
    assert json.loads(df.select(F.to_json("b")).first()[0]) == json.loads(bundle(A, []))


def test_files(spark, tmp_path):
    for name, body in (("a.pdf", b"one"), ("sub/b.pdf", b"two"), ("sub/copy.pdf", b"one"), ("_processed/c.pdf", b"three"), ("note.txt", b"no"), ("D.PDF", b"no")):
        p = tmp_path / "papers" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    found = files.list_files(spark, str(tmp_path / "papers"))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.select("path").collect()) == ["a.pdf", "b.pdf", "copy.pdf"]
    assert files.unique_papers(found).count() == 2
    assert files.find_one(found, "b.pdf").endswith("sub/b.pdf")
    with pytest.raises(ValueError):
        files.find_one(found, "none.pdf")
    counted = found.select(files.page_counter(lambda raw: len(raw) if raw == b"one" else 1 // 0).alias("n"))
    assert sorted(r["n"] for r in counted.collect()) == [0, 3, 3]


def test_generator_retries(spark):
    prompts = spark.createDataFrame([("m", "good"), ("m", "repair me"), ("m", "empty"), ("m", "down")], "model string, prompt string")

    def answer(model, prompt):
        if prompt.startswith("down"):
            raise ConnectionError("no server")
        if prompt.startswith("empty"):
            return " "
        return "ok" if prompt == "good" or "failed validation" in prompt else "wrong"

    got = {r["prompt"]: (r["answer"], r["error"], r["attempts"]) for r in generator.generate(prompts, answer, lambda a: None if a == "ok" else "not ok").collect()}
    assert got["good"] == ("ok", None, 1) and got["repair me"] == ("ok", None, 2)
    assert got["empty"][1] == "empty answer" and got["down"][1].startswith("ConnectionError")


def test_answer_stream(spark):
    lines = [(1, 1, '{"thinking": "hmm"}'), (1, 2, '{"response": "a"}'), (1, 3, '{"response": "b", "done": true}'), (1, 4, '{"response": "late"}'), (2, 1, '{"response": "open"}')]
    got = {r["request"]: tuple(r)[1:] for r in generator.stream_answer(spark.createDataFrame(lines, "request int, seq int, line string")).collect()}
    assert got == {1: ("ab", 3, True), 2: ("open", 0, False)}


def test_render_hook(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("graph {}",), ("broken",), (None,)], "dot string")
    got = [r[0] for r in df.select(generator.rendered(F.col("dot"), lambda s: "<svg/>" if s.startswith("graph") else 1 // 0)).collect()]
    assert got == ["<svg/>", None, None]


def test_graph_follows_papers(spark, parts, tmp_path):
    """A changed paper rewrites its own rows only; a gone one loses them; nothing new is no commit."""
    from pyspark.sql import functions as F

    from veristrand.plans.graph_sync import GraphTables, sync_graph

    papers, drawn = parts
    t = GraphTables(spark, f"file://{tmp_path}")
    assert {tuple(r) for r in sync_graph(t, papers, drawn).collect()} == {(A, "new"), (B, "new")}
    same = lambda p, d: all(sorted(map(str, x.collect())) == sorted(map(str, y.collect())) for x, y in zip(t.read(), graph.graph(p, d), strict=True))
    assert same(papers, drawn) and t.nodes.version() == 1
    assert sync_graph(t, papers, drawn).count() == 0 and t.nodes.version() == 1
    renamed = papers.withColumn("paper_name", F.when(F.col("paper_hash") == B, "two").otherwise(F.col("paper_name")))
    assert [tuple(r) for r in sync_graph(t, renamed, drawn).collect()] == [(B, "changed")]
    delta = t.nodes.commits.entry(2, "graph_nodes")["deltas"][-1]
    assert {r["paper_hash"] for r in spark.read.parquet(f"{tmp_path}/{delta}").collect()} == {B} and same(renamed, drawn)
    assert [tuple(r) for r in sync_graph(t, renamed.where(F.col("paper_hash") != A), drawn).collect()] == [(A, "gone")]
    nodes, edges = t.read()
    assert nodes.count() == 4 and edges.count() == 3 and edges.where("type = 'HAS_DIAGRAM'").count() == 0
    redrawn = drawn.withColumn("title", F.lit("other"))
    assert [r["change"] for r in sync_graph(t, renamed, redrawn).collect()] == ["new"] and same(renamed, redrawn)


def test_files_are_hashed_as_far_as_asked(spark, tmp_path):
    import hashlib

    from pyspark.sql import functions as F

    from veristrand.plans.batch import hashed_until

    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(200):
        (folder / f"{i}.txt").write_text(f"file {i}")
    found = files.list_files(spark, str(folder), "*.txt").select("path", "content")
    wanted = lambda *names: spark.createDataFrame([(hashlib.sha256(f"file {i}".encode()).hexdigest(),) for i in names], "content_hash string")
    assert hashed_until(found, wanted(0).where("false")).count() == 0
    assert hashed_until(found, wanted("no such")).count() == 200
    share = F.pmod(F.xxhash64("path"), F.lit(4096))
    early = found.orderBy(share).select(F.sha2("content", 256).alias("content_hash")).limit(1)
    some = hashed_until(found, early, first=20)
    assert some.join(early, "content_hash").count() == 1 and some.count() < 100  # about twenty
    assert hashed_until(found.where("false"), wanted(1)).count() == 0


def test_missing_models(spark):
    class Listed:
        def __init__(self, names):
            self.names = names

        def models(self):
            if self.names is None:
                raise ConnectionError("no server")
            return self.names

    wanted = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "model string")
    generator.check_models(wanted, Listed(["a", "b", "c"]))
    generator.check_models(wanted, Listed(None))
    generator.check_models(wanted, lambda model, prompt: "")
    with pytest.raises(generator.ModelsMissing, match="b$"):
        generator.check_models(wanted, Listed(["a"]))


def test_language_files(spark, tmp_path):
    import hashlib
    import os

    from pyspark.sql import functions as F

    from veristrand.functions.text import language_fingerprint
    from veristrand.sources.ocr import language_files

    asked = spark.createDataFrame([("eng+deu",), ("deu",), ("fra",)], "langs string")
    told = lambda: {r["langs"]: r["f"] for r in asked.crossJoin(F.broadcast(language_files(spark, str(tmp_path / "data")))).select("langs", language_fingerprint(F.col("langs"), F.col("files")).alias("f")).collect()}
    assert set(told().values()) == {"no-tessdata"}
    (tmp_path / "data").mkdir()
    for name in ("eng", "deu"):
        (tmp_path / "data" / f"{name}.traineddata").write_bytes(b"x" * 10)
        os.utime(tmp_path / "data" / f"{name}.traineddata", (1000, 1000.25))
    want = lambda *parts: hashlib.sha256("|".join(parts).encode()).hexdigest()[:10]
    assert told() == {"eng+deu": want("deu:10:1000250000000", "eng:10:1000250000000"), "deu": want("deu:10:1000250000000"), "fra": want("fra:missing")}
