"""Dropped lines against a plain restatement; runs, their levels and batches."""

import hashlib
import random

import pytest

from veristrand.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, least_chars=40, least_docs=5):
    """(doc_id, lines, dropped, kept) of each row."""
    number = lambda d: -(1 << 63) if d is None else d
    held: dict = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(number(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or len(held[key(x)]) < least_docs or number(d) == max(held[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    pool = [f"Line number {i} Of a pool that many documents share ÄÖ" for i in range(30)] + ["short", "", "x" * 39, "y" * 40, "  " + "y" * 40 + "\t\r", "ÉCOLE " * 8, "école " * 8, "İSTANBUL ΣΑΣ " * 4]
    out = [(i * 3, "\n".join(r.choice(pool) if r.random() < 0.6 else f"own line {i} {r.random()} and some more words" for _ in range(r.randrange(1, 15)))) for i in range(120)]
    common = "This line stands in every third document of the table"
    out += [(1000 + i, common.upper() if i % 2 else f"\x0b{common}\x0c\nrest {i}") for i in range(60)]
    out += [(2, None), (4, ""), (5, "\n"), (7, f"{common}\n" * 3), (None, f"{common}\nno id"), (None, common), (9, pool[0]), (9, pool[0]), (9, pool[1]), (11, "\n".join(f"{common} {k}" for k in range(20_000)) + f"\n{common}")]
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("batches", [1, 6])
def test_report(docs_of, rows, batches):
    got = line_dedup.line_report(docs_of(rows), batches=batches).collect()
    want = [(d, n, gone, sha(kept)) for d, n, gone, kept in plain(rows)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and sum(w[2] for w in want) > 300


def test_texts(docs_of, rows):
    got = line_dedup.drop_lines(docs_of(rows), least_chars=30, least_docs=3).collect()
    want = [(d, None if t is None else kept) for (d, t), (*_, kept) in zip(rows, plain(rows, 30, 3), strict=True)]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str) and all(r["words"] == 7 for r in got)


def test_batches_as_they_arrive(spark, docs_of):
    """A line stays where it first came, of one batch in the largest doc_id; runs are compacted by level."""
    r = random.Random(8)
    lines = [f"a line that may come again and again, number {i}" for i in range(60)]
    batches = [[(100 * b + i, "\n".join(r.choice(lines) for _ in range(4))) for i in range(6)] for b in range(7)]
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=3)
    seen: set = set()
    for batch in batches:
        got = {d["doc_id"]: d["text"] for d in line_dedup.drop_known_lines(docs_of(batch), runs).collect()}
        holder = {x: max(d for d, t in batch if x in t.split("\n")) for _, t in batch for x in t.split("\n")}
        assert got == {d: "\n".join(x for x in t.split("\n") if x not in seen and holder[x] == d) for d, t in batch}
        seen |= set(holder)
    assert [len(level) for level in runs.levels] == [1, 1, 1]  # seven is 111 in twos
    held = runs.keepers()
    assert held.count() == held.select("h1", "h2").distinct().count() == len(seen)
    plan = runs.unseen(held.select("h1", "h2", "keeper"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Bucketed: true") >= 3
    runs.close()


def test_empty_and_native(docs_of):
    report = line_dedup.line_report(docs_of([(1, "a")]).limit(0))
    assert report.count() == 0 and "Python" not in report._jdf.queryExecution().executedPlan().toString()
