"""Runs against brute force over all periods; reports and collapsed texts against plain restatements."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from veristrand.llm import periodic_runs
from veristrand.llm.common import words_of


def brute(w, least=6, times=4):
    found: dict = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((i, j - i, p) for (i, j), p in found.items())


def word(r, kind):
    n = r.randrange(0, 80)
    if kind < 2:
        return [r.randrange(2 + 2 * kind) for _ in range(n)]
    out: list = []
    while len(out) < n:
        out += [r.randrange(3) for _ in range(r.randrange(1, 5))] * r.randrange(1, 7)
    return out if kind == 2 else [*out[:30] * r.randrange(1, 6), 9, *out]


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (5, 3)])
def test_all_runs(least, times):
    r = random.Random(least)
    for _ in range(250):
        docs = [word(r, r.randrange(4)) for _ in range(r.randrange(1, 6))]
        assert periodic_runs.runs_of([np.array(d, dtype=np.int64) for d in docs], least, times) == [brute(d, least, times) for d in docs]


def test_long_documents():
    one, mixed = np.zeros(300_000, dtype=np.int64), np.arange(300_000) % 7
    assert periodic_runs.runs_of([one, mixed]) == [[(0, 300_000, 1)], [(0, 300_000, 7)]]
    short, fib = [0], [0, 1]
    while len(fib) < 5_000:
        short, fib = fib, fib + short
    assert periodic_runs.runs_of([np.array(fib)], 2, 2)[0] == brute(fib, 2, 2)


def test_suffixes():
    """Suffix order, LCPs both ways and longest previous factors against their definitions."""
    r = random.Random(3)
    for _ in range(60):
        docs = [[r.randrange(3) for _ in range(r.randrange(1, 25))] for _ in range(3)]
        flat = [(d, w) for d, doc in enumerate(docs) for w in doc]
        s = periodic_runs.Suffixes(np.array([w for _, w in flat]), np.array([d for d, _ in flat]))
        assert s.array.tolist() == sorted(range(len(flat)), key=lambda i: flat[i:])
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        a, b = (np.array([r.randrange(len(flat)) for _ in range(40)]) for _ in "ab")
        apart = a != b
        a, b = a[apart], b[apart]
        assert s.lcp(a, b).tolist() == [common(flat[i:], flat[j:]) for i, j in zip(a, b, strict=True)]
        assert s.lcs(a, b).tolist() == [common(flat[:i][::-1], flat[:j][::-1]) for i, j in zip(a, b, strict=True)]
        size, source = s.previous_factors()
        assert size.tolist() == [max([common(flat[i:], flat[j:]) for j in range(i)], default=0) for i in range(len(flat))]
        assert all(n == 0 or (j < i and flat[i : i + n] == flat[j : j + n]) for i, (n, j) in enumerate(zip(size, source, strict=True)))


def planted(doc_id, text):
    w = words_of(text)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def restated(doc_id, text):
    w = planted(doc_id, text)
    runs = brute(w)
    best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
    gone = {k for i, m, p in runs for k in range(i + p, i + m)}
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    shas = ["".join(f"{i},{m},{p}\n" for i, m, p in runs).encode(), b" ".join(x for k, x in enumerate(w) if k not in gone)]
    return (doc_id, len(runs), *top, *(hashlib.sha256(x).hexdigest() for x in shas))


def test_report(docs_of, prose):
    rows = [(i, prose(40 + i, i, size=4 + i)) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "ha " * 500), (204, "a b c " * 9 + prose(2_000, 1)), (None, "x y " * 8), (205, "no no no no no"), (206, "no no no no no no"), (207, "É é É é É é É é"), (3, rows[3][1])]
    got = periodic_runs.runs_report(docs_of(rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((restated(*r) for r in rows), key=str) and sum(r["n_runs"] > 0 for r in got) > 10


def test_collapse(docs_of):
    rows = [(1, "go go go go go go  home"), (2, "kept   as it  is"), (3, None), (4, ""), (5, "a b a b a b a b\nc"), (5, "a b a b a b a b\nc")]
    got = periodic_runs.collapse_runs(docs_of(rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["text"] is not None) == [(1, "go home"), (2, "kept   as it  is"), (4, ""), (5, "a b c"), (5, "a b c")]
    assert all(r["size"] == 7 and r["words"] == 7 for r in got) and len(got) == 6
    assert [[tuple(x) for x in r["runs"]] for r in got if r["doc_id"] == 1] == [[(0, 6, 1)]]


def test_empty(docs_of):
    none = docs_of([(1, "a")]).limit(0)
    assert periodic_runs.runs_report(none).count() == periodic_runs.collapse_runs(none).count() == 0
