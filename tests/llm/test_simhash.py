import random

import numpy as np
import pytest
import xxhash

from veristrand.llm import simhash
from veristrand.llm.common import min_labels, words_of


def plain_fingerprint(text):
    w = words_of(text, lower=True)
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
    f = np.array([fps[i] for i in order], dtype=np.uint64)
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3)
    lab = min_labels(len(f), a, b)
    return {(ids[i], fps[i]): ids[order[lab[k]]] for k, i in enumerate(order)}


def test_fingerprint_vectors():
    assert simhash.fingerprint([]) == 0
    for t in ["one", "one two", "A b C d e f", "x " * 70_000, "É é A\x0bB\x1cC"]:
        assert simhash.fingerprint(words_of(t, lower=True)) == plain_fingerprint(t)


def test_every_pair_in_reach_shares_a_block_key():
    r = random.Random(1)
    keys = simhash.block_keys()
    assert len(keys) == 10
    for _ in range(2000):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), 3):
            y ^= 1 << b
        assert any(x & k == y & k for k in keys)


def test_components_against_brute_force(docs_of, prose):
    base = [prose(300, i) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    r = random.Random(5)
    for i in range(200):  # chains of small edits, exact copies
        w = r.choice(rows)[1].split()
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = "edit"
        rows.append((100 + i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "word"), (904, "WORD"), (904, "WORD"), (None, base[0]), (905, "long " * 50_000)]
    got = [(x["doc_id"], int(x["fingerprint"], 16), x["component_id"]) for x in simhash.simhash_components(docs_of(rows)).collect()]
    assert len(got) == len(rows)
    assert sorted((i if i is not None else -1, f) for i, f, _ in got) == sorted((i if i is not None else -1, plain_fingerprint(t)) for i, t in rows)
    want = plain_components([g[0] for g in got], [g[1] for g in got])
    assert all(want[i, f] == c for i, f, c in got)


def test_large_bucket_grows_like_small_ones():
    r = np.random.default_rng(3)
    centre = np.uint64(0x123456789ABCDEF0)
    flips = np.array([np.uint64(0)] + [np.bitwise_or.reduce(np.uint64(1) << r.choice(20, k, replace=False).astype(np.uint64)) for k in r.integers(1, 7, 400)])
    x = np.unique(centre ^ flips)
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    table = np.bitwise_count(x[:, None] ^ simhash.PIVOTS[None, :]).astype(np.int8)
    assert np.array_equal(simhash._grow(x, table, 3), min_labels(len(x), a, b))
    order = np.argsort(x.view(np.int64))
    k = np.zeros(len(x), dtype=np.int8)
    one, two = simhash._bucket_links(k, np.zeros(len(x), dtype=np.int64), x.view(np.int64)[order], 3)
    assert len(one) < len(x) and set(two) <= set(x.view(np.int64))


def test_dedup_keeps_one_of_each_group(docs_of, prose):
    t = prose(200, 1)
    docs = docs_of([(3, t), (2, t), (2, t), (5, prose(200, 2)), (None, t), (7, None), (8, "")])
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 2), (False, 5), (False, 7), (True, 0)]


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_small_tables(docs_of, rows):
    assert simhash.simhash_components(docs_of(rows)).count() == len(rows)
    assert simhash.simhash_dedup(docs_of(rows)).count() == len(rows)
