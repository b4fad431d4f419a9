from pyspark.sql import functions as F

from veristrand.constants import MODEL_TIERS
from veristrand.functions import generated, text
from veristrand.schemas import MAP_ANSWER


def one(spark, value, *columns, kind="string"):
    return tuple(spark.createDataFrame([(value,)], f"x {kind}").select(*columns).first())


def test_normalise(spark):
    for raw in ["  A b\t\nC ", "Straße", "\x1ca\x1fb", "", "ÄÖ  Ü　x"]:
        got = one(spark, raw, text.normalise("x"), text.normalise_full("x"))
        assert got[0] == got[1] == " ".join(raw.casefold().split())
    assert one(spark, "ΣΑΣ ﬁ", text.normalise_full("x"))[0] == "σασ fi"
    assert one(spark, None, text.normalise("x"), text.normalise_full("x")) == (None, None)


def test_bounded(spark):
    assert one(spark, "   x y \n", text.bounded("x", 2))[0] == "x "
    assert one(spark, " \t", text.bounded("x", 5))[0] is None
    assert one(spark, "a😀é", text.bounded("x", 2))[0] == "a😀"


def test_identity(spark):
    good = "0a" * 32
    for value, ok in ((good, True), (good.upper(), False), (good[:16], False), ("short", False), (None, False), (good + "\n", False)):
        assert one(spark, value, text.is_identity("x"))[0] is ok


def test_model_tiers(spark):
    d, r = MODEL_TIERS["default"], MODEL_TIERS["reasoning"]
    for n, want in ((0, d), (35, d), (36, r), (200, r), (201, d), (999, d), (5000, d)):
        assert one(spark, n, text.select_model(F.col("x")), kind="int")[0] == want
    assert one(spark, 5, text.select_model(F.col("x"), F.lit("mine")), text.select_model(F.col("x"), F.lit("")), kind="int") == ("mine", d)


def test_ids_and_formats(spark):
    assert one(spark, 1234, text.evidence_id(F.lit(7), F.col("x")), kind="int")[0] == "C007-E1234"
    for n, want in ((None, "?"), (0, "0B"), (1023, "1023B"), (1024, "1KB"), (5 << 20, "5MB"), (3 << 30, "3GB"), (3 << 40, "3.0TB")):
        assert one(spark, n, text.bytes_text(F.col("x")), kind="long")[0] == want
    for n, want in ((None, "?"), (59.9, "0m59s"), (3600.0, "1h0m0s"), (86461.0, "24h1m1s")):
        assert one(spark, n, text.duration_text(F.col("x")), kind="double")[0] == want
    path = "p" * 70
    assert one(spark, path, text.display_path(F.col("x")))[0] == "…" + path[-57:]
    assert one(spark, "short.pdf", text.display_path(F.col("x")))[0] == "short.pdf"


def test_profile_key_depends_on_each_part(spark):
    def key(*parts):
        return one(spark, 1, text.ocr_profile(*map(F.lit, parts)), kind="int")[0]

    base = (300, "eng", "5.3", "1.24", "abc")
    keys = {key(*base)} | {key(*(*base[:i], other, *base[i + 1 :])) for i, other in enumerate((150, "deu", "5.4", "1.25", "abd"))}
    assert len(keys) == 6 and all(len(k) == 12 for k in keys)


def test_json_object(spark):
    latex = '```json\n{"chunk_summary": "velocity \\dot{u} and \\u0041", "evidence": []}\n```'
    assert one(spark, latex, generated.json_object("x", MAP_ANSWER)["chunk_summary"])[0] == "velocity \\dot{u} and A"
    control = '{"chunk_summary": "a\x01b", "evidence": [{"kind": "method", "statement": "s", "support": "q", "page": "3"}]}'
    got = one(spark, control, generated.json_object("x", MAP_ANSWER))[0]
    assert got["chunk_summary"] == "a\x01b" and got["evidence"][0]["page"].toPython() == "3"  # a text stays one
    assert one(spark, "nothing here", generated.json_object("x", MAP_ANSWER))[0] is None


def test_first_json_object(spark):
    f = generated.first_json_object("x")
    assert one(spark, 'well {broken, then {"a": 1} and {"b": 2}', f)[0] == '{"a":1}'
    assert one(spark, "[] none", f)[0] is None
    assert one(spark, '{"a": "x\\', f)[0] is None
    assert one(spark, '{"t": "\\theta \\alpha \\u12"}', f)[0] == '{"t":"\\theta \\\\alpha \\\\u12"}'


def test_diagrams(spark):
    def parse(raw):
        return [tuple(d) for d in one(spark, raw, generated.diagrams("x"))[0]]

    good = "===DIAGRAM_START: One===\ndigraph A {}\n===DIAGRAM_END===\n===DIAGRAM_START: Two===\ngraph B {}\n===DIAGRAM_END==="
    assert parse(good) == [("One", "digraph A {}"), ("Two", "graph B {}")]
    assert parse(good.replace("DIAGRAM_END", "DIOD_END", 1)) == parse(good)
    assert parse(good.replace("===DIAGRAM_END===", "")) == parse(good)
    assert parse("===DIAGRAM_START: One===\nno picture") == []
    assert parse("text\n```dot\ndigraph X { a }\n```\n```\ngraph Y {}\n```") == [("diagram_01", "digraph X { a }"), ("diagram_02", "graph Y {}")]
    assert parse("===DIAGRAM_START: One===\nprose\n```dot\ndigraph X {}\n```")[0][0] == "One"


def test_label_repair(spark):
    def fix(raw):
        return one(spark, raw, generated.repair_labels("x"))[0]

    assert fix("Node [\"label='x'\"];") == 'Node [label="x"];'
    assert fix("Node [\"label='x'];") == 'Node [label="x"];'
    assert fix("A [\"label='a\\n\"b\"'\"]; B [\"label='c'\"]") == 'A [label="a\\\\n\\"b\\""]; B [label="c"]'
    assert fix('Node [label="x"];') == 'Node [label="x"];'


def test_style(spark):
    out = one(spark, "digraph G { a } graph H { b }", generated.with_style("x"))[0]
    assert out.count("bgcolor") == 1 and out.startswith("digraph G {\n  graph [bgcolor") and out.endswith(" a } graph H { b }")
    assert one(spark, "graph { bgcolor=red }", generated.with_style("x"))[0] == "graph { bgcolor=red }"
