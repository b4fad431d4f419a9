import hashlib
import itertools
import random

import numpy as np
import pytest

from veristrand.llm import substring_dedup as sd
from veristrand.llm.common import words_of


def brute(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            w = words_of(t)
            for s in range(len(w) - 12):
                k = tuple(w[s : s + 13])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        if i is not None:
            for s in range(len(w) - 12):
                if first[tuple(w[s : s + 13])] < i:
                    gone[s : s + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((-1 if i is None else i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def report(docs):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sd.substring_report(docs).collect())


@pytest.fixture(scope="module")
def mixed(prose):
    r = random.Random(9)
    passages = [prose(n, 100 + n, 50) for n in (12, 13, 14, 20, 60)]
    rows = []
    for i in range(150):
        parts = [prose(r.randrange(0, 40), i, 30 if i % 3 else 5000)]
        for _ in range(r.randrange(4)):
            p = r.choice(passages).split()
            if r.random() < 0.4:  # a word changed: the ends of the repeat differ
                p[r.randrange(len(p))] = "changed"
            parts += [" ".join(p), prose(r.randrange(0, 15), 1000 + i)]
        rows.append((i, "\n".join(parts)))
    rows += [(200 + i, rows[7][1]) for i in range(40)]  # copies
    rows += [(300, None), (301, ""), (302, " \t"), (303, "the " * 400), (304, "the " * 30), (304, "the " * 30), (None, rows[7][1]), (305, rows[9][1] + " " + prose(20_000, 77))]
    rows += [(306, rows[3][1]), (306, rows[4][1])]  # one id, two texts
    r.shuffle(rows)
    return rows


def test_against_brute_force(docs_of, mixed):
    assert report(docs_of(mixed)) == brute(mixed)


def test_small_batches_and_frequent_anchors(docs_of, mixed, monkeypatch):
    monkeypatch.setattr(sd, "_ROWS", 50)
    monkeypatch.setattr(sd, "FREQUENT", 0.001)
    assert report(docs_of(mixed)) == brute(mixed)


def test_cut_texts(docs_of, prose):
    a, b = prose(20, 1), prose(20, 2)
    docs = docs_of([(1, f"{a}\n{b}"), (2, f"begin\n\n{b}\n end"), (3, a), (4, ""), (5, None), (None, b)])
    kept = sd.substring_dedup(docs)
    assert kept.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert got == {1: f"{a}\n{b}", 2: "begin\n end", 4: "", 5: None, None: b}
    assert {r["doc_id"]: r["n_chars"] for r in kept.collect()}[2] == 10


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b")]])
def test_small_tables(docs_of, rows):
    assert report(docs_of(rows)) == brute(rows)
    assert sd.substring_dedup(docs_of(rows)).count() == len(rows)


@pytest.mark.parametrize("piece", [1 << 18, 64, 7])
def test_texts_laid_end_to_end(prose, monkeypatch, piece):
    """Anchors of documents that are read together are those of each alone; digests don't follow where pieces end."""
    monkeypatch.setattr(sd, "_PIECE", piece)
    raws = [b"", b" \n", b"one two", prose(12, 1).encode(), prose(13, 2).encode(), b"\t" + prose(300, 3).encode() + b" ", b"the " * 50, "é ü\x0bß\x1cx ".encode() * 9, b"w" * 500]
    t = sd.Text(b" ".join(raws))
    assert [b" ".join(raws)[i:].split(maxsplit=1)[0] for i in t.starts] == b" ".join(raws).split()
    edges = [0, *itertools.accumulate(len(r.split()) for r in raws)]
    together = sorted(zip(*(x.tolist() for x in t.anchors(np.array(edges))), strict=True))
    alone = []
    for i, r in enumerate(raws):
        own = sd.Text(r)
        alone += [(*x, i) for x in zip(*(x.tolist() for x in own.anchors(np.array([0, own.n]))[:4]), strict=True)]
    assert together == sorted(alone) and {x[4] for x in alone} == {4, 5, 6, 7}
    words = [w for r in raws for w in r.split()]
    digests = t.runs(np.arange(t.n), 1).tolist()
    assert len(set(zip(words, digests, strict=True))) == len(set(words)) == len(set(digests))
