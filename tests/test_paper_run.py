"""From pages to stored sections with a generator of fixed answers."""

import json
import re

import pytest
from pyspark.sql import functions as F

from veristrand import session
from veristrand.constants import SECTIONS
from veristrand.operators import bundles, graph, store
from veristrand.plans import paper_run
from veristrand.schemas import DIAGRAMS, PAPERS
from veristrand.sources.ocr import read_image

PROMPTS = {s: f"Write {s}." for s in SECTIONS}


def answer(model, prompt):
    if prompt.startswith("Quote evidence"):
        found = re.findall(r"\[PAGE (\d+)\]\n([^\n]{5,40})", prompt)
        items = [{"kind": "method", "statement": f"page {n}", "support": t, "page": int(n)} for n, t in found]
        items.append({"kind": "result", "statement": "made up", "support": "nowhere to be found", "page": 1})
        if "UNREADABLE" in prompt:
            return "I can not."
        return "```json\n" + json.dumps({"chunk_summary": f"{len(items)} items", "evidence": items}) + "\n```"
    if prompt.startswith("Summarise"):
        ids = list(dict.fromkeys(re.findall(r"C\d+-E\d+", prompt)))
        return json.dumps({"summary": "root", "selected_evidence_ids": ids, "relationships": [{"evidence_ids": ids[:2], "description": "go together"}, {"evidence_ids": [ids[0], "C9-E9"], "description": "bad"}]})
    if prompt.startswith("Write diagrams"):
        return "===DIAGRAM_START: One===\ndigraph A { a [\"label='x'\"] }\n===DIARGAM_END===" if "A page of paper 1" in prompt else "no picture"
    return f"{model}: {prompt.split('.')[0]}"


@pytest.fixture(scope="module")
def run(spark):
    pages = [(1, n, f"A page of paper 1, number {n}, says something.", "native") for n in range(1, 31)] + [(2, 1, "One page of paper 2 only.", "native"), (3, 1, "UNREADABLE", "native")]
    p = spark.createDataFrame(pages, "paper int, number int, text string, method string")
    papers = spark.createDataFrame([(i, str(i) * 64, 30 if i == 1 else 1, "m", "code" if i == 1 else None, ["summary"] if i == 2 else []) for i in (1, 2, 3)], "paper int, paper_hash string, page_count int, model string, code_model string, sections_completed array<string>")
    found = paper_run.extract(p, papers.select("paper", "model"), answer)
    return found, papers


def test_evidence(run):
    found, _ = run
    items = found.items.orderBy("evidence_id").collect()
    assert sum(r["paper"] == 1 for r in items) == 30 and sum(r["paper"] == 2 for r in items) == 1  # overlapping pages count once
    assert {(r["paper"], r["error"]) for r in found.failed.collect()} == {(3, "chunk 1: no JSON object with chunk_summary")}
    assert {r["rejected_items"] for r in found.chunks.where("paper = 1").collect()} == {1}
    roots = {r["paper"]: r for r in found.roots.collect()}
    assert (roots[1]["page_start"], roots[1]["page_end"], roots[1]["levels"], len(roots[1]["ids"])) == (1, 30, 1, 16)
    assert [r["description"] for r in found.relations.where("paper = 1").collect()] == ["go together"]


def test_bundle_is_reusable(run):
    found, papers = run
    corpora = paper_run.corpora(found, papers).join(papers.select("paper_hash", F.col("model").alias("model_used")), "paper_hash")
    assert all(r["reusable"] for r in bundles.reusable(corpora).collect()) and corpora.count() == 2
    assert not any(r["reusable"] for r in bundles.reusable(corpora.withColumn("model_used", F.lit("other"))).collect())
    broken = corpora.withColumn("source_corpus", F.replace("source_corpus", F.lit('"kind":"method"'), F.lit('"kind":"guess"')))
    assert not any(r["reusable"] for r in bundles.reusable(broken).collect())
    totals = graph.import_totals(graph.parsed(corpora.withColumn("paper_name", F.lit("n"))))
    assert {(r["evidence"], r["relations"]) for r in totals.collect()} == {(30, 1), (1, 0)}


def test_sections(spark, run):
    found, papers = run
    answers = paper_run.write_up(found, papers, answer, PROMPTS)
    got = {(r["paper_hash"][0], r["section"]): r["answer"] for r in answers.collect()}
    assert set(got) == {("1", s) for s in SECTIONS} | {("2", s) for s in SECTIONS if s != "summary"}
    assert got["1", "cpp"].startswith("code:") and got["2", "cpp"].startswith("m:")
    rows = [{f.name: None for f in PAPERS} | {"paper_hash": str(i) * 64, "sections_completed": ["summary"] if i == 2 else []} for i in (1, 2, 3)]
    table = spark.createDataFrame([tuple(r.values()) for r in rows], PAPERS)
    stored, drawn = paper_run.store_answers(table, spark.createDataFrame([], DIAGRAMS), answers, "t1")
    done = {r["paper_hash"][0]: r for r in stored.collect()}
    assert sorted(done["1"]["sections_completed"]) == sorted(SECTIONS) and "diagrams" not in done["2"]["sections_completed"] and done["3"]["sections_completed"] == []
    assert done["2"]["diagrams_raw"] == "no picture" and done["1"]["summary_md"] == "# Summary\n\nm: Write summary\n"
    dot = drawn.first()["dot_src"]
    assert drawn.count() == 1 and '[label="x"]' in dot and "bgcolor" in dot
    assert store.paper(stored, "1" * 64).count() == 1 and store.diagrams_of(drawn, "1" * 64).count() == 1 and store.svg_of(drawn, "1" * 64, 1).count() == 0
    both = {r["paper_hash"][0]: len(r["diagrams"]) for r in store.with_diagrams(stored.withColumn("source_corpus", F.lit("{}")), drawn).collect()}
    assert both == {"1": 1, "2": 0, "3": 0}


def test_fenced_split(spark):
    changes = spark.createDataFrame([(1, "a"), (2, "b")], "write_id long, value string")
    judged = spark.createDataFrame([(1, True), (2, False)], "write_id long, accepted boolean")
    ok, late = store.fenced(changes, judged)
    assert [r["value"] for r in ok.collect()] == ["a"] and [r["value"] for r in late.collect()] == ["b"]


def test_page_reader(spark):
    df = spark.createDataFrame([(b"image",), (b"",), (None,)], "image binary")
    assert [r[0] for r in df.select(read_image(F.col("image"), lambda raw: f"{1 // len(raw)} read")).collect()] == ["0 read", "", ""]


def liar(model, prompt):
    """Quotes nothing that is there at first in chunk 2, never in chunk 3 of paper 7, selects an unknown id at first and for ever in paper 8."""
    again = "failed validation" in prompt
    if prompt.startswith("Quote"):
        chunk = int(re.search(r"Chunk: (\d+)", prompt)[1])
        if chunk == 2 and not again or chunk == 3 and "paper 7" in prompt:
            return json.dumps({"chunk_summary": "s", "evidence": [{"kind": "method", "statement": "x", "support": "nowhere", "page": 1}]})
        return answer(model, prompt)
    if prompt.startswith("Summarise"):
        ids = list(dict.fromkeys(re.findall(r"C\d+-E\d+", prompt.split("The last response")[0])))
        extra = ["C999-E001"] if not again or "paper 8" in prompt else []
        return json.dumps({"summary": "fixed" if again else "first", "selected_evidence_ids": [*ids[-3:], *extra], "relationships": []})
    return answer(model, prompt)


def test_retries_and_failures(spark):
    pages = [(i, n, f"A page of paper {i}, number {n}, says something.", "native") for i in (6, 7, 8) for n in range(1, 26)]
    p = spark.createDataFrame(pages, "paper int, number int, text string, method string")
    found = paper_run.extract(p, spark.createDataFrame([(i, "m") for i in (6, 7, 8)], "paper int, model string"), liar)
    failed = {r["paper"]: r["error"] for r in found.failed.collect()}
    assert failed[7] == "chunk 3: all proposed evidence failed source verification"
    assert failed[8].startswith("reduction, group 1: unknown evidence ids: C999-E001") and set(failed) == {7, 8}
    roots = found.roots.collect()
    assert [(r["paper"], r["summary"]) for r in roots] == [(6, "fixed")]
    last = {r["evidence_id"] for r in found.items.orderBy("chunk_index", "ord").collect()[-3:]}
    assert last <= set(roots[0]["ids"]) and len(roots[0]["ids"]) <= 16
    assert {r["paper"] for r in found.items.collect()} == {6} == {r["paper"] for r in found.chunks.collect()}


def test_empty_answers_reload_the_model(spark):
    from veristrand.sources.generator import AnswerTimeout, generate

    class Model:
        loaded = False

        def __call__(self, model, prompt):
            if prompt == "slow":
                raise AnswerTimeout("900 s")
            return "fine" if self.loaded else " "

        def reload(self, model):
            self.loaded = True

    rows = generate(spark.createDataFrame([("m", "ask"), ("m", "slow")], "model string, prompt string").coalesce(1), Model()).collect()
    assert [(r["answer"], r["error"], r["attempts"]) for r in rows] == [("fine", None, 2), (None, "AnswerTimeout: 900 s", 1)]


def test_prompts_of_one_model_go_to_many_tasks_and_are_not_kept(spark):
    rows = [(1, i, "m", "ask " * 50 + str(i)) for i in range(200)]
    asked = spark.createDataFrame(rows, "paper int, chunk_index int, model string, prompt string")
    merge = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = paper_run._dealt(asked).select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge)
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 100
    held = spark.createDataFrame([(1, i, 1, f"page {i}") for i in range(200)], "paper int, chunk_index int, number int, text string")
    judged, _ = paper_run.ask_chunks(asked, held, lambda model, prompt: json.dumps({"chunk_summary": "s", "evidence": []}))
    assert judged.count() == 200 and "prompt" not in judged.columns


def test_compressed_tables(spark):
    kept = spark.conf.get(session._CLEANUP)
    df = spark.range(1000).selectExpr("id % 7 AS k", "repeat('text ', 20) AS text").groupBy("k").agg(F.first("text").alias("text"), F.count("k").alias("n"))
    out = session.compressed(df)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect())) and out.dtypes == df.dtypes
    files = out.inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files) and spark.conf.get(session._CLEANUP) == kept
