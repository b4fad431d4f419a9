"""A batch of papers from pages to stored sections.

pages -> chunks -> proposals -> verified evidence -> reduction -> bundle -> section contexts
-> answers -> next states of the tables. The generator is called in three places only (chunks,
groups of a reduction level, sections), each a ``mapInPandas`` over prompts dealt out by model;
all else is relational.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CHUNK_SUMMARY_CHARS, CONTEXT_CAPS, GROUP, MAX_SELECTED, OVERLAP, RETRIES, SECTIONS, SUMMARY_CHARS, WINDOW
from ..functions import generated, text
from ..operators import bundles, chunks, context, evidence, store, synthesis
from ..schemas import BUNDLE, MAP_ANSWER, REDUCE_ANSWER
from ..session import compressed, cut_lineage
from ..sources.generator import Generator, generate, map_prompt, rendered, repair_of


@dataclass
class Evidence:
    """What a batch of papers was synthesised to."""

    chunks: DataFrame  # paper, chunk_index, page_start, page_end, summary, rejected_items
    items: DataFrame  # de-duplicated evidence
    roots: DataFrame  # paper, page_start, page_end, ids, levels, summary
    relations: DataFrame  # paper, nth, ids, description
    failed: DataFrame  # paper, error


def _dealt(prompts: DataFrame) -> DataFrame:
    """Prompts of one model in neighbouring tasks, so that a task loads one model, or the two that meet in it."""
    return prompts.repartitionByRange("model", F.xxhash64("prompt")).sortWithinPartitions("model")


def _object(answer: str | None) -> dict:
    found = generated._first_object(answer or "")
    value = json.loads(found) if found else None
    return value if isinstance(value, dict) else {}


def _check_map(answer: str) -> str | None:
    """What is wrong with a chunk's answer, before its evidence is verified."""
    value = _object(answer)
    if not (isinstance(value.get("chunk_summary"), str) and value["chunk_summary"].strip()):
        return "no JSON object with chunk_summary"
    return None if isinstance(value.get("evidence", []), list) else "evidence is no list"


def _check_reduce(answer: str, allowed) -> str | None:
    """What is wrong with a group's answer: its summary, or ids that the group doesn't hold."""
    value = _object(answer)
    if not (isinstance(value.get("summary"), str) and value["summary"].strip()):
        return "no JSON object with summary"
    ids = value.get("selected_evidence_ids", [])
    if not isinstance(ids, list):
        return "selected_evidence_ids is no list"
    unknown = sorted({str(i) for i in ids} - set(allowed))
    if unknown:
        return f"unknown evidence ids: {', '.join(unknown[:20])}"
    return None if isinstance(value.get("relationships", []), list) else "relationships is no list"


def _judged(asked: DataFrame, held: DataFrame, generator: Generator) -> tuple[DataFrame, DataFrame]:
    """Answers to asked (paper, chunk_index, model, prompt) with found and error, and their proposals checked; no prompts."""
    answers = compressed(generate(_dealt(asked), generator, _check_map, retries=0).drop("prompt", "attempts"))
    read = answers.withColumn("found", F.from_json(generated.first_json_object("answer"), MAP_ANSWER))
    said = read.where("error is null").select("paper", "chunk_index", F.posexplode("found.evidence").alias("ord", "e")).select("paper", "chunk_index", "ord", "e.kind", "e.statement", "e.support", "e.page")
    checked = compressed(evidence.check_proposals(said, held))
    judged = read.join(evidence.rejected_counts(checked), ["paper", "chunk_index"], "left")
    return judged.withColumn("error", F.coalesce("error", evidence.chunk_error(F.col("accepted_items"), F.col("rejected_items")))), checked


def ask_chunks(asked: DataFrame, held: DataFrame, generator: Generator, retries: int = RETRIES) -> tuple[DataFrame, DataFrame]:
    """Answers to asked (paper, chunk_index, model, prompt) and their checked proposals.

    A chunk whose answer can't be read, or of whose proposals none holds, is asked again with
    its error and last answer, all such chunks of a batch together. What is still wrong then
    keeps its error.
    """
    key = ["paper", "chunk_index"]
    judged, checked = _judged(asked, held, generator)
    for _ in range(retries):
        judged = cut_lineage(judged)
        bad = judged.where("error is not null")
        again = bad.join(asked.select(*key, F.col("prompt").alias("first")), key).select(*key, "model", repair_of(F.col("first"), F.col("answer"), F.col("error")).alias("prompt"))
        later, proved = _judged(again, held, generator)
        checked = checked.join(bad.select(*key), key, "left_anti").unionByName(proved)
        judged = judged.where("error is null").unionByName(later)
    return cut_lineage(judged), checked


def extract(pages: DataFrame, models: DataFrame, generator: Generator, window: int = WINDOW, overlap: int = OVERLAP) -> Evidence:
    """pages: paper, number, text, method. models: paper, model.

    A paper fails, and yields nothing but its error, if a chunk or a reduction fails after its
    retries or if no evidence holds.
    """
    frags = chunks.fragments(pages)
    members = compressed(chunks.chunk_fragments(frags, chunks.chunk_bounds(frags, window, overlap)))
    held = chunks.chunk_pages(members)
    numbers = held.groupBy("paper", "chunk_index").agg(F.sort_array(F.collect_set("number")).alias("numbers"))
    asked = chunks.render(members).join(numbers, ["paper", "chunk_index"]).join(models, "paper").select("paper", "chunk_index", "model", map_prompt(F.col("content"), F.col("chunk_index"), F.col("numbers")).alias("prompt"))
    judged, checked = ask_chunks(asked, held, generator)
    bad = judged.where("error is not null").groupBy("paper").agg(F.min_by(F.format_string("chunk %d: %s", "chunk_index", "error"), "chunk_index").alias("error"))
    good = cut_lineage(judged.join(bad, "paper", "left_anti"))
    items = cut_lineage(evidence.first_claims(evidence.with_ids(checked.join(bad, "paper", "left_anti"))))
    told = good.select("paper", "chunk_index", text.bounded("found.chunk_summary", CHUNK_SUMMARY_CHARS).alias("summary"), F.coalesce("rejected_items", F.lit(0)).alias("rejected_items"))
    about = chunks.chunk_summary(members).join(told, ["paper", "chunk_index"]).select("paper", "chunk_index", "page_start", "page_end", F.coalesce("summary", F.lit("")).alias("summary"), "rejected_items")
    own = items.groupBy("paper", "chunk_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "evidence_id"))), lambda x: x["evidence_id"]).alias("ids"))
    leaves = about.join(own, ["paper", "chunk_index"], "left").select("paper", (F.col("chunk_index") - 1).alias("idx"), "page_start", "page_end", "summary", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    known = items.select("paper").distinct()
    roots, relations, unreduced = _reduced(leaves.join(known, "paper", "left_semi"), items, models, generator)
    empty = models.select("paper").join(known, "paper", "left_anti").join(bad, "paper", "left_anti").select("paper", F.lit("no source-verifiable evidence").alias("error"))
    failed = cut_lineage(bad.unionByName(unreduced).unionByName(empty))
    whole = lambda rows: rows.join(failed, "paper", "left_anti")
    return Evidence(whole(about), whole(items), whole(roots), whole(relations), failed)


def _reduced(dossiers: DataFrame, items: DataFrame, models: DataFrame, generator: Generator) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roots, their relations, and the papers that a group's answer failed (paper, error).

    Each level asks the generator about each group of four: its answer selects among the
    group's ids, and an unknown id is refused and asked for again. A paper of one dossier
    needs no answer.
    """
    dossiers = cut_lineage(dossiers)
    count = dossiers.groupBy("paper").count()
    levels = cut_lineage(count.select("paper", synthesis.levels_of(F.col("count")).alias("levels")))
    most = count.agg(F.max("count")).first()[0] or 0
    told: DataFrame | None = None
    failed = levels.select("paper", F.lit("").alias("error")).where("false")
    line = F.concat_ws(" | ", "evidence_id", "kind", F.substring("statement", 1, 700), F.substring("support", 1, 400))
    ask = f"Summarise this evidence as a JSON object with summary, selected_evidence_ids (at most {MAX_SELECTED}) and relationships (evidence_ids, description).\n\n"
    while most > 1:
        n = F.count(F.lit(1)).over(Window.partitionBy("paper"))
        open_ = cut_lineage(dossiers.withColumn("n", n))
        groups = cut_lineage(synthesis.group_level(open_.where("n > 1").drop("n"), items))
        records = groups.select("paper", "grp", F.posexplode("available").alias("nth", "evidence_id")).join(items, ["paper", "evidence_id"])
        records = records.groupBy("paper", "grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"]), "\n").alias("records"))
        child = synthesis.groups_of(open_.where("n > 1"), "idx").groupBy("paper", "grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.format_string("Pages %d-%d: %s", "page_start", "page_end", "summary").alias("line")))), lambda x: x["line"]), "\n").alias("children"))
        prompt = F.concat(F.lit(ask + "INPUT:\n"), "children", F.lit("\n\n"), F.coalesce("records", F.lit("")))
        asked = groups.join(child, ["paper", "grp"]).join(records, ["paper", "grp"], "left").join(models, "paper").select("paper", "grp", "model", prompt.alias("prompt"), F.col("available").alias("allowed"))
        answers = cut_lineage(generate(_dealt(asked), generator, _check_reduce, RETRIES))
        bad = answers.where("error is not null").groupBy("paper").agg(F.min_by(F.format_string("reduction, group %d: %s", F.col("grp") + 1, "error"), "grp").alias("error"))
        failed = cut_lineage(failed.unionByName(bad))
        read = answers.where("error is null").select("paper", "grp", F.from_json(generated.first_json_object("answer"), REDUCE_ANSWER).alias("a"))
        chosen = groups.join(read, ["paper", "grp"]).join(failed, "paper", "left_anti")
        none = F.array().cast("array<string>")
        next_ = synthesis.select_level(chosen, items, F.coalesce("a.selected_evidence_ids", none)).join(chosen.select("paper", F.col("grp").alias("idx"), text.bounded("a.summary", SUMMARY_CHARS).alias("summary")), ["paper", "idx"])
        said = chosen.select("paper", F.col("grp").alias("idx"), F.posexplode("a.relationships").alias("nth", "r")).select("paper", "idx", "nth", F.col("r.evidence_ids").alias("ids"), F.col("r.description").alias("description"))
        said = cut_lineage(synthesis.valid_relationships(said.join(next_.select("paper", "idx", F.col("ids").alias("selected")), ["paper", "idx"])).drop("selected"))
        told = said if told is None else told.join(open_.where("n > 1").select("paper").distinct(), "paper", "left_anti").unionByName(said)
        cols = ["paper", "idx", "page_start", "page_end", "summary", "ids"]
        dossiers = cut_lineage(open_.where("n = 1").select(*cols).unionByName(next_.select(*cols)))
        most = -(-most // GROUP)
    none = levels.select("paper", F.lit(0).alias("nth"), F.array().cast("array<string>").alias("ids"), F.lit("").alias("description")).where("false")
    roots = dossiers.join(levels, "paper").select("paper", "page_start", "page_end", "ids", "levels", "summary")
    return roots, (none if told is None else told.select("paper", "nth", "ids", "description")), failed


def write_up(found: Evidence, papers: DataFrame, generator: Generator, prompts: dict[str, str], reprocess: str | None = None) -> DataFrame:
    """paper_hash, section, answer, error of the sections still to be done.

    papers: paper, paper_hash, page_count, model, code_model, sections_completed. prompts:
    instruction of each section. Only ``cpp`` uses the code model.
    """
    out = None
    base = found.roots.join(papers.select("paper", "page_count"), "paper")
    todo = store.pending_sections(papers, reprocess)
    for section in SECTIONS:
        bounded = context.contexts(base, found.chunks, found.items, found.relations, section, CONTEXT_CAPS[section]).where("error is null")
        model = F.coalesce("code_model", "model") if section == "cpp" else F.col("model")
        rows = papers.join(todo.where(F.col("section") == section), "paper_hash").join(bounded, "paper")
        rows = rows.select("paper_hash", F.lit(section).alias("section"), model.alias("model"), F.concat(F.lit(prompts[section] + "\n\n"), "context").alias("prompt"))
        out = rows if out is None else out.unionByName(rows)
    return generate(_dealt(out), generator).select("paper_hash", "section", "answer", "error")


def store_answers(papers: DataFrame, diagrams: DataFrame, answers: DataFrame, now: str, render: Callable[[str], str | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Next states of papers and diagrams. An answer without a diagram is kept raw, its section open.

    render makes SVG of DOT source; a diagram that it can't draw is kept without one.
    """
    good = answers.where("error is null")
    for section in SECTIONS:
        own = good.where(F.col("section") == section).select("paper_hash", "answer")
        if section != "diagrams":
            papers = store.write_sections(papers, own.select("paper_hash", text.section_markdown(F.lit(section), F.col("answer")).alias("content")), section, now)
            continue
        drawn = own.withColumn("found", generated.diagrams("answer"))
        items = F.transform("found", lambda d: F.struct(d["title"].alias("title"), generated.with_style(generated.repair_labels(d["dot"])).alias("dot"), F.lit(None).cast("string").alias("svg")))
        some = drawn.where("size(found) > 0")
        parsed = some.select("paper_hash", items.alias("items"))
        if render:
            each = parsed.select("paper_hash", F.posexplode("items").alias("at", "d")).withColumn("svg", rendered(F.col("d.dot"), render))
            each = each.groupBy("paper_hash").agg(F.sort_array(F.collect_list(F.struct("at", F.struct("d.title", "d.dot", "svg").alias("d")))).alias("x"))
            parsed = each.select("paper_hash", F.transform("x", lambda x: x["d"]).alias("items"))
        diagrams = store.replace_diagrams(diagrams, parsed)
        papers = store.mark_complete(papers, some, "diagrams", now)
        papers = store.write_raw_diagrams(papers, drawn.where("size(found) = 0").select("paper_hash", F.col("answer").alias("raw")), now)
    return papers, diagrams


def corpora(found: Evidence, papers: DataFrame) -> DataFrame:
    """paper_hash, source_corpus: bundles for the papers table."""
    b = bundles.build(papers.select("paper", "paper_hash", "model", "page_count"), found.chunks, found.items, found.roots, found.relations)
    return b.join(papers.select("paper", "paper_hash"), "paper").select("paper_hash", "source_corpus")


def load(papers: DataFrame) -> Evidence:
    """Evidence out of stored bundles: papers (paper, source_corpus, ...)."""
    b = cut_lineage(papers.withColumn("b", F.from_json("source_corpus", BUNDLE)).where("b is not null").select("paper", "b"))
    c = b.select("paper", F.explode("b.chunks").alias("c"))
    about = c.select("paper", "c.chunk_index", "c.page_start", "c.page_end", "c.summary", "c.rejected_items")
    items = c.select("paper", F.posexplode("c.evidence").alias("ord", "e")).select("paper", "ord", "e.*")
    roots = b.select("paper", "b.root.page_start", "b.root.page_end", F.col("b.root.selected_evidence_ids").alias("ids"), F.col("b.reduction_levels").alias("levels"), "b.root.summary")
    relations = b.select("paper", F.posexplode("b.root.relationships").alias("nth", "r")).select("paper", "nth", F.col("r.evidence_ids").alias("ids"), "r.description")
    return Evidence(about, items, roots, relations, b.select("paper", F.lit("").alias("error")).where("false"))
