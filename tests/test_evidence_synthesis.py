import itertools

import pytest
from pyspark.sql import functions as F
from restated import coverage

from veristrand.operators import evidence, synthesis
from veristrand.operators.context import contexts
from veristrand.schemas import MAP_ANSWER


def test_verification(spark):
    page = spark.createDataFrame([(1, 1, 7, " The  Straße is LONG. " + "q" * 700)], "paper int, chunk_index int, number int, text string")
    rows = [
        ("method", "s", "the strasse is long.", "7", True),
        (" METHOD ", "s", "THE STRASSE", " +7 ", True),
        ("method", "s", "the strasse", "7.9", False),  # a text is no number with a fraction
        ("method", "s", "the strasse", "7.0", False),
        ("method", "s", "not there", "7", False),
        ("method", "s", "the strasse", "8", False),
        ("guess", "s", "the strasse", "7", False),
        ("method", " ", "the strasse", "7", False),
        ("method", "s", "", "7", False),
        ("method", "s", "q" * 600 + "!", "7", True),  # cut to 600 before it is verified
        (None, "s", "the strasse", "7", False),
        ("method", "s", "the strasse", "seven", False),
    ]
    given = [(1, 1, i, *r[:4]) for i, r in enumerate(rows)]
    proposals = spark.createDataFrame(given, "paper int, chunk_index int, ord int, kind string, statement string, support string, page string")
    checked = evidence.check_proposals(proposals, page)
    assert [r["accepted"] for r in checked.orderBy("ord").collect()] == [r[4] for r in rows]
    assert [r["evidence_id"] for r in evidence.with_ids(checked).orderBy("ord").collect()] == ["C001-E001", "C001-E002", "C001-E003"]
    assert evidence.rejected_counts(checked).first()["rejected_items"] == 9


def test_page_numbers_by_json_type(spark):
    """A JSON number is cut towards zero, a JSON text must be whole; null, objects and numbers beyond an int name no page."""
    want = {"7": 7, "7.9": 7, "-0.5": 0, "7e0": 7, '"7"': 7, '" 7 "': 7, '"7.0"': None, '"7.9"': None, '"seven"': None, '""': None, "true": 1, "null": None, "[7]": None, '{"a":7}': None, "12345678901234567890123": None}
    rows = spark.createDataFrame([(k,) for k in want], "given string").select("given", F.from_json(F.concat(F.lit('{"evidence":[{"page":'), "given", F.lit("}]}")), MAP_ANSWER)["evidence"][0]["page"].alias("page"))
    got = rows.select("given", evidence.page_number(F.col("page"), rows.schema["page"].dataType).alias("n"))
    assert {r["given"]: r["n"] for r in got.collect()} == want


def test_dedupe_keeps_gaps(spark):
    rows = [(1, "C001-E001", 1, 1, "Same Quote", 2), (1, "C002-E001", 2, 1, "same  quote", 2), (1, "C002-E002", 2, 2, "same quote", 3), (2, "C001-E001", 1, 1, "same quote", 2)]
    items = spark.createDataFrame(rows, "paper int, evidence_id string, chunk_index int, ord int, support string, page int")
    got = {(r["paper"], r["evidence_id"]) for r in evidence.first_claims(items).collect()}
    assert got == {(1, "C001-E001"), (1, "C002-E002"), (2, "C001-E001")}


def test_coverage_vectors():
    want = {0: [], 1: [0], 2: [0, 1], 3: [0, 2, 1], 4: [0, 3, 1, 2], 5: [0, 4, 2, 1, 3], 8: [0, 7, 3, 1, 2, 4, 6, 5], 16: [0, 15, 7, 1, 6, 3, 8, 14, 11, 2, 4, 5, 9, 10, 12, 13]}
    for n, order in want.items():
        assert list(coverage(n)) == order
    for n in range(120):
        assert sorted(coverage(n)) == list(range(n))


def test_coverage_order_is_native(spark):
    rows = [(n, i) for n in (1, 2, 3, 7, 16, 65, 300, 1000) for i in range(n)]
    df = synthesis.coverage_order(spark.createDataFrame(rows, "paper int, page int"), ["paper"], ["page"], "page")
    got: dict = {}
    for r in df.orderBy("paper", "ord").collect():
        got.setdefault(r["paper"], []).append(r["page"])
    assert got == {n: list(coverage(n)) for n in got} and len(got) == 8
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_coverage_of_two_stays_as_given(spark):
    rows = [(1, 0, 9), (1, 1, 2), (2, 0, 5), (2, 1, 1), (2, 2, 3)]
    got = synthesis.coverage_order(spark.createDataFrame(rows, "paper int, nth int, page int"), ["paper"], ["page"], "nth")
    assert [(r["paper"], r["page"]) for r in got.orderBy("paper", "ord").collect()] == [(1, 9), (1, 2), (2, 1), (2, 5), (2, 3)]


def spread(ids, pages):
    known = [i for i in ids if i in pages]
    order = known if len(known) < 3 else [sorted(known, key=pages.get)[i] for i in coverage(len(known))]
    return order


def reduced(dossiers, pages, chosen):
    levels = 0
    while len(dossiers) > 1:
        levels += 1
        out = []
        for group in itertools.batched(dossiers, 4):
            reps = [i for d in group for i in spread(d, pages)[:2]]
            available = list(dict.fromkeys(i for d in group for i in d))
            out.append(spread(list(dict.fromkeys([*reps, *available[:chosen]])), pages)[:16])
        dossiers = out
    return dossiers[0], levels


def test_reduction_against_plain_restatement(spark):
    leaves, items, want = [], [], {}
    for paper, n in enumerate((1, 2, 4, 5, 17, 20), 1):
        own, pages = [], {}
        for c in range(n):
            ids = [f"C{c + 1:03d}-E{k:03d}" for k in range(1, 2 + (c * 7 + paper) % 9)] if (c + paper) % 6 else []
            pages |= {i: c * 3 + (k * 5) % 7 for k, i in enumerate(ids)}
            own.append(ids)
            leaves.append((paper, c, c * 10 + 1, c * 10 + 12, ids))
        items += [(paper, i, p) for i, p in pages.items()]
        want[paper] = reduced(own, pages, 4)
    d = spark.createDataFrame(leaves, "paper int, idx int, page_start int, page_end int, ids array<string>")
    e = spark.createDataFrame(items, "paper int, evidence_id string, page int")
    got = {r["paper"]: r for r in synthesis.reduce_all(d, e, F.slice("available", 1, 4)).collect()}
    assert {p: (r["ids"], r["levels"]) for p, r in got.items()} == want
    assert (got[6]["page_start"], got[6]["page_end"], got[6]["levels"]) == (1, 202, 3)


def test_levels(spark):
    for n, want in ((1, 0), (2, 1), (4, 1), (5, 2), (16, 2), (17, 3), (64, 3), (65, 4)):
        assert spark.range(1).select(synthesis.levels_of(F.lit(n))).first()[0] == want


def test_relationships(spark):
    rows = [(["a", "b"], " x "), (["a", "a"], "x"), (["a", "z"], "x"), (["a", "b"], "  "), (["b", "a", "b", "c"], "y" * 2000), (["a"], "x")]
    df = spark.createDataFrame([(i, *r, ["a", "b", "c"]) for i, r in enumerate(rows)], "n int, ids array<string>, description string, selected array<string>")
    got = synthesis.valid_relationships(df).orderBy("n").collect()
    assert [(r["n"], r["ids"], len(r["description"])) for r in got] == [(0, ["a", "b"], 1), (4, ["b", "a", "c"], 1500)]


def test_packing(spark):
    df = spark.createDataFrame([(1, [5, 7, 3, 9, 1])], "paper int, e array<int>")
    assert df.select(synthesis.skip_fit(F.col("e"), lambda x: x, 0, 14)).first()[0] == [5, 7, 1]
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 7, 3, 9, 1])], "paper int, i int, n int")
    assert [r["n"] for r in synthesis.prefix_fit(rows, ["paper"], "i", F.col("n"), 14).orderBy("i").collect()] == [5, 7]


def test_context(spark):
    papers = spark.createDataFrame([(1, 9, 1, "root", ["C001-E002"]), (2, 1, 0, "r" * 3000, [])], "paper int, page_count int, levels int, summary string, ids array<string>")
    chunk = spark.createDataFrame([(1, 1, 1, 5, "one"), (1, 2, 4, 9, "two " * 100)], "paper int, chunk_index int, page_start int, page_end int, summary string")
    items = spark.createDataFrame([(1, "C001-E001", "result", 2, "big", "q" * 900), (1, "C001-E002", "method", 3, "chosen", "q1"), (1, "C002-E001", "definition", 8, "first kind", "q2")], "paper int, evidence_id string, kind string, page int, statement string, support string")
    told = spark.createDataFrame([(1, 1, ["C001-E002", "C002-E001"], "linked"), (1, 2, ["C001-E002", "C001-E001"], "x" * 1000), (1, 3, ["C001-E002", "C001-E001"], "late")], "paper int, nth int, ids array<string>, description string")
    got = {r["paper"]: r for r in contexts(papers, chunk, items, told, "logic", 700).collect()}
    text = got[1]["context"]
    assert got[2]["context"] is None and got[2]["error"]
    assert "- Pages 1–5: one\n" in text and "two two" not in text
    assert text.index("[C001-E002] method; page 3") < text.index("[C002-E001] definition; page 8") and "C001-E001] result" not in text
    assert "- C001-E002, C002-E001: linked\n" in text and "late" not in text and len(text) <= 700 + 28


@pytest.mark.parametrize("section,first", [("summary", "C001-E002"), ("logic", "C002-E001"), ("extras", "C001-E001")])
def test_section_order(spark, section, first):
    items = spark.createDataFrame([(1, "C001-E001", "result", 2), (1, "C001-E002", "motivation", 9), (1, "C002-E001", "definition", 8)], "paper int, evidence_id string, kind string, page int")
    want = {"summary": "C001-E002", "logic": "C002-E001", "extras": "C001-E001"}
    assert synthesis.remainder_order(items, section).where("ord = 1").first()["evidence_id"] == want[section] == first
