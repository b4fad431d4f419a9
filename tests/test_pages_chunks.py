import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from restated import windows

from veristrand.operators import chunks, pages


def route(spark, rows, cache=(), **options):
    p = spark.createDataFrame(rows, "paper int, number int, text string, ocr string")
    c = spark.createDataFrame(list(cache), "paper int, page_idx int, text string")
    return pages.route_pages(p, c, **options)


def methods(df):
    return {(r["paper"], r["number"]): (r["method"], r["text"]) for r in df.collect()}


def test_routing(spark):
    rows = [(1, 1, "x" * 99, "seen"), (1, 2, "x" * 100, "seen"), (1, 3, "", ""), (1, 4, "", "found"), (1, 5, "few", "")]
    got = methods(route(spark, rows, [(1, 3, "kept")]))
    assert got == {(1, 1): ("ocr", "seen"), (1, 2): ("native", "x" * 100), (1, 3): (None, None), (1, 4): ("ocr-cache", "kept"), (1, 5): ("native", "few")}
    assert methods(route(spark, rows, mode="never"))[(1, 4)] == (None, None)
    assert methods(route(spark, rows, mode="always"))[(1, 2)] == ("ocr", "seen")
    assert methods(route(spark, rows, available=False))[(1, 1)] == ("native", "x" * 99)
    with pytest.raises(ValueError):
        route(spark, rows, mode="maybe")


def test_empty_cache_entry_is_a_hit(spark):
    got = methods(route(spark, [(1, 1, "native", "fresh"), (1, 2, "", "fresh")], [(1, 0, ""), (1, 1, " ")]))
    assert got == {(1, 1): ("ocr-cache", "native"), (1, 2): (None, None)}


def test_budget_counts_fresh_pages_only(spark):
    rows = [(p, n, "", f"ocr{n}") for p in (1, 2) for n in range(1, 6)]
    routed = route(spark, rows, [(1, 0, "cached")], budget=2)
    assert [r["number"] for r in pages.extracted(routed).where("paper = 1").orderBy("number").collect()] == [1, 2, 3]
    assert [r["number"] for r in pages.extracted(routed).where("paper = 2").orderBy("number").collect()] == [1, 2]
    stats = pages.ocr_stats(spark.createDataFrame([(1,), (3,)], "paper int"), routed).withColumn("s", pages.ocr_summary()).orderBy("paper").collect()
    assert tuple(stats[0])[1:-1] == (5, 0, 2, 1, 2, 2) and stats[0]["s"] == "5 pages → 0 native, 2 OCR'd, 1 cached, 2 still-blank, 2 budget-capped"
    assert stats[1]["s"] == "0/0 pages had native text (no OCR needed)"
    assert pages.extracted(route(spark, rows, budget=0)).count() == 10


def test_golden_windows():
    def bounds(sizes, **options):
        return [(a + 1, b + 1) for a, b in windows(sizes, **options)]

    assert bounds([3000] * 20) == [(1, 12), (11, 20)]
    assert bounds([3000] * 35) == [(1, 12), (11, 22), (21, 32), (31, 35)]
    assert bounds([30000] * 4) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert bounds([20000] * 5) == [(1, 2), (2, 3), (3, 4), (4, 5)]
    assert bounds([]) == []


def test_bounds_are_those_windows(spark):
    """The native fold against the plain walk, over stretches of a list's limits and beyond."""
    import random

    r = random.Random(4)
    lists = {i: [r.choice((0, 5, 900, 2500, 5000)) for _ in range(r.choice((0, 1, 2, 7, 60)))] for i in range(60)} | {100: [r.randrange(700) for _ in range(3000)], 101: [6000] * 1030}
    rows = [(p, i, n) for p, sizes in lists.items() for i, n in enumerate(sizes)]
    frags = spark.createDataFrame(rows, "paper int, pos int, n int").selectExpr("paper", "pos", "repeat('x', n) AS text")
    for window, overlap, cap in ((12, 2, 4000), (1, 0, 1000), (5, 4, 2500)):
        got: dict = {}
        for x in chunks.chunk_bounds(frags, window, overlap, cap).orderBy("paper", "chunk_index").collect():
            got.setdefault(x["paper"], []).append((x["first"], x["last"]))
            assert x["chunk_index"] == len(got[x["paper"]])
        assert got == {p: list(windows(sizes, window, overlap, cap)) for p, sizes in lists.items() if sizes}


def test_long_page_in_fragments(spark):
    p = spark.createDataFrame([(1, 1, "a" * 10, "native"), (1, 2, "b" * 100_000, "native"), (1, 3, "c" * 10, "native")], "paper int, number int, text string, method string")
    f = chunks.fragments(p)
    m = chunks.chunk_fragments(f, chunks.chunk_bounds(f))
    got = [(r["page_start"], r["page_end"]) for r in chunks.chunk_summary(m).orderBy("chunk_index").collect()]
    assert got == [(1, 1), (2, 2), (2, 2), (2, 3)]
    text = chunks.render(m).where("chunk_index = 1").first()["content"]
    assert text == "[PAGE 1]\n" + "a" * 10
    page = chunks.chunk_pages(m).where("chunk_index = 4 and number = 2").first()["text"]
    assert page == " " + "b" * (100_000 - 2 * 47_936)


@pytest.mark.parametrize("args", [(0, 0, 2000), (2, 2, 2000), (2, -1, 2000), (2, 1, 999)])
def test_bad_windows(args):
    with pytest.raises(ValueError):
        chunks.check_windows(*args)


@settings(deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=60), st.integers(1, 8), st.data())
def test_windows_cover_in_order(sizes, window, data):
    overlap = data.draw(st.integers(0, window - 1))
    found = list(windows(sizes, window, overlap, 4000))
    assert sorted({i for a, b in found for i in range(a, b + 1)}) == list(range(len(sizes)))
    for (a, b), (c, _) in zip(found, found[1:], strict=False):
        assert a < c <= b + 1
    for a, b in found:
        assert b - a < window and (a == b or sum(sizes[a : b + 1]) + 32 * (b + 1 - a) <= 4000)
