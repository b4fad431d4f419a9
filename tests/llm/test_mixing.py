import pytest

from veristrand.llm import mixing
from veristrand.llm.common import words_of


def targets(sizes):
    """Shares by weight, none above three times its source, by repeated sharing of the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        new = {s for s in names if s not in capped and rest * weight[s] / free > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / free for s in names}
        capped |= new


@pytest.fixture(scope="module")
def rows(prose):
    rows = [(i, prose(1 + i * 7 % 300, i), "en", f"s{i % 7}") for i in range(400)]
    rows += [(1000 + i, prose(30, i), "en", "tiny") for i in range(3)] + [(2000, prose(40_000, 5), "en", "huge"), (2001, None, "en", "huge"), (2002, "", "en", "nothing")]
    return rows + [(3000, "a b c", "en", None), (3000, "a b c", "en", None), (None, "x y", "en", "é"), (3001, "z " * 5, None, "S0")]


def test_report(docs_of, rows):
    docs = docs_of(rows)
    got = [tuple(r) for r in mixing.mix_report(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, map(tuple, mixing.mix_report(docs.repartition(7)).collect())))  # reruns agree
    assert sorted(str((r[0], r[1])) for r in got) == sorted(str((i, len(words_of(t)))) for i, t, *_ in rows)
    sizes: dict = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    want = targets(sizes)
    by = {(i, len(words_of(t))): s for i, t, _, s in rows}
    taken: dict = {}
    for i, n, source, target, took in got:
        s = by[i, n]
        assert source == sizes[s] and abs(target - want[s]) < 1e-6 * max(1, target) and 0 <= took <= 3 * n
        taken[s] = taken.get(s, 0) + took
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(3, 0.02 * want[s])


def test_mix_takes_what_the_report_says(docs_of, rows):
    unique = [r for r in rows if r[0] != 3000 and r[0] is not None]
    docs = docs_of(unique)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got: dict = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words_of(r["text"]))
    assert got == {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs).collect() if r["taken"]}


def test_mix_tells_sources_apart(spark, docs_of, prose):
    """Rows of equal doc_id and text in two sources: each source gets the words that the report says."""
    docs = docs_of([(1, "one two three", "en", "x"), (1, "one two three", "de", "y"), *((i, prose(40, i), "en", "xy"[i % 2]) for i in range(10, 30))])
    words: dict = {}
    for r in mixing.mix(docs).collect():
        key = r["doc_id"], r["source"]
        words[key] = words.get(key, 0) + len(words_of(r["text"]))
        assert r["lang"] == ("de" if key == (1, "y") else "en") and r["digest"] == 7
    sizes = {s: sum(len(words_of(r["text"])) for r in docs.where(f"source = '{s}'").collect()) for s in "xy"}
    want = targets(sizes)
    for s in "xy":
        assert abs(sum(n for (_, src), n in words.items() if src == s) - want[s]) <= max(3, 0.02 * want[s])
    report = sum(r["taken"] for r in mixing.mix_report(docs).collect())
    assert sum(words.values()) == report


def test_schedule_is_spread_out(spark, docs_of, prose):
    docs = docs_of([(i, prose(500, i), "en", "ab"[i % 2]) for i in range(40)])
    _, goals = mixing._prepared(docs)
    plan = mixing.schedule(goals).orderBy("slot").toPandas()
    share = (plan["src"] == "=a").mean()
    for n in (64, 512, len(plan)):
        assert abs((plan["src"][:n] == "=a").mean() - share) < 6 / n
    assert plan["slot"].is_unique and plan["pass"].max() < 3


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")], [(1, "one word", "en", "s")]])
def test_small_tables(docs_of, rows):
    got = mixing.mix_report(docs_of(rows)).collect()
    assert len(got) == len(rows) and all(abs(r["taken"] - r["target"]) < 1e-9 for r in got)
    assert mixing.mix(docs_of(rows)).count() == sum(r["size"] > 0 for r in got)
