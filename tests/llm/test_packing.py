import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veristrand.llm import packing
from veristrand.llm.queries import tokenizer_path

pytestmark = pytest.mark.skipif(not Path(tokenizer_path()).exists(), reason="vocabulary files are not here")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def test_words_encode_as_the_whole_text_does(tokenizer):
    e = packing.Encoder(tokenizer_path(), bound=500)
    r = random.Random(3)
    alphabet = "aAbzÉéÀßñÑüÜøİıſŉ.,!?;:'s\"-_09<|>ÅǺ  ΣσςЖж中🙂\x1c\x85 \t\n"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(5000)]
    for t in [*texts, "a<|endoftext|>b it's don't I'LL we're", "É" * 50, "x" * 5000, ""]:
        assert list(np.frombuffer(e.document(t), dtype="<u4")) == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
    assert list(np.frombuffer(e.document(None), dtype="<u4")) == [1]


@settings(deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=40))
def test_plan_fills_sequences(sizes):
    pieces, n = packing.plan(sizes)
    covered = [sorted((s, m) for i, s, m, _, _ in pieces if i == d) for d in range(len(sizes))]
    for own, size in zip(covered, sizes, strict=True):
        assert own[0][0] == 0 and sum(m for _, m in own) == size
        assert all(a + m == b for (a, m), (b, _) in zip(own, own[1:], strict=False))
    for s in range(n):
        own = sorted((o, m) for *_, m, q, o in [(i, st_, m, q, o) for i, st_, m, q, o in pieces] if q == s)
        assert own[0][0] == 0 and all(a + m == b for (a, m), (b, _) in zip(own, own[1:], strict=False))
        total = sum(m for _, m in own)
        assert total <= 2048 and total & (total - 1) == 0


def plain_plan(sizes, length=2048):
    """The rule of the module word for word: whole sequences first, then the longest rest to the cheapest sequence with room."""
    out, free, n = [], [], 0
    for i, size in enumerate(sizes):
        for at in range(0, size // length * length, length):
            out.append((i, at, length, n, 0))
            n += 1
    rests = sorted(((s % length, i) for i, s in enumerate(sizes) if s % length), key=lambda x: (-x[0], x[1]))
    total = sum(r for r, _ in rests)
    free = [[0.0, n + k, length, 0] for k in range(total // length)]  # cost, number, room, used
    last, tail = n + len(free), total % length
    tails = [[0.0, last + k, 1 << b, 0] for k, b in enumerate(b for b in range(11, -1, -1) if tail >> b & 1)]
    for left, i in rests:
        at = sizes[i] - left
        while left:
            open_ = [f for f in free if f[3] < f[2]] or [t for t in tails if t[3] < t[2]][:1]
            f = min(open_, key=lambda x: (x[0], x[1]))
            m = min(left, f[2] - f[3])
            out.append((i, at, m, f[1], f[3]))
            f[0], f[3] = f[0] + packing.LINEAR * m + packing.QUADRATIC * m * m, f[3] + m
            at, left = at + m, left - m
    return out


@settings(deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=40))
def test_plan_against_plain_rule(sizes):
    assert sorted(packing.plan(sizes)[0]) == sorted(plain_plan(sizes))


def test_costs_are_balanced():
    sizes = [random.Random(i).randrange(50, 1500) for i in range(400)]
    pieces, n = packing.plan(sizes)
    cost = np.zeros(n)
    for _, _, m, s, _ in pieces:
        cost[s] += packing.LINEAR * m + packing.QUADRATIC * m * m
    full = cost[: sum(sizes) // 2048]
    assert full.max() / full.min() < 2


def test_pack(docs_of, prose, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "BIN_TOKENS", 5000)
    rows = [(i, prose(i * 13 % 400, i)) for i in range(60)] + [(100, None), (101, ""), (102, prose(30_000, 1)), (None, "x"), (3, "twice"), (3, "twice")]
    got = packing.pack(docs_of(rows), tokenizer_path()).toPandas()
    ids = {}
    for i, t in rows:
        ids.setdefault(-1 if i is None else i, []).append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    for r in got.fillna(-1).itertuples():
        assert any(len(a) == r.doc_tokens and zlib.crc32(a[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for a in ids[int(r.doc_id)])
    assert got["length"].sum() == sum(len(a) for own in ids.values() for a in own)
    assert got["row_id"].nunique() == len(rows) and (got.groupby("row_id")["length"].sum() == got.groupby("row_id")["doc_tokens"].first()).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 2048


def test_sequences_hold_the_ids(docs_of, prose, tokenizer):
    rows = [(i, prose(200, i)) for i in range(20)]
    out = packing.sequences(docs_of(rows), tokenizer_path()).collect()
    want = sorted(x for _, t in rows for x in [*tokenizer.encode(t, add_special_tokens=False).ids, 1])
    assert sorted(x for r in out for x, s in zip(r["ids"], r["segments"], strict=True) if s) == want
    assert all(len(r["ids"]) == len(r["segments"]) <= 2048 for r in out)
    own = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    for r in out:
        for k, (d, at) in enumerate(zip(r["doc_ids"], r["starts"], strict=True), 1):
            piece = [x for x, s in zip(r["ids"], r["segments"], strict=True) if s == k]
            assert own[d][at : at + len(piece)] == piece


def test_empty_table(docs_of):
    assert packing.pack(docs_of([]), tokenizer_path()).count() == 0
    assert packing.sequences(docs_of([]), tokenizer_path()).count() == 0


def test_words_of_a_bin_are_encoded_once():
    e = packing.Encoder(tokenizer_path())
    plain, asked = e._encode, []
    e._encode = lambda word: asked.append(word) or plain(word)
    text = " ".join(f"w{chr(97 + i % 26)}{i:x}" for i in range(200_000))
    assert e.document(text) == e.document(text) and len(asked) == 200_000
