import random
import zlib

import pytest

from veristrand.llm import toxicity

LABELS = "doc_id long, quality int, toxic int, score int"
MEAN = ["vile", "rotten", "filthy", "hateful"]


@pytest.fixture(scope="module")
def corpus(docs_of, spark, prose):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        w = prose(r.randrange(10, 400), i, 800).split()
        bad = i % 6 == 0
        if bad:
            for _ in range(1 + len(w) // 150):
                w.insert(r.randrange(len(w)), r.choice(MEAN))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad), 0))
    rows += [(5000, None), (5001, ""), (5002, "vile " * 40_000), (5003, "12 !? ..."), (5, rows[5][1]), (None, "plain words")]
    labels += [(5, 1, 0, 0), (None, 1, 1, 0), (7000, 1, None, 0)]
    return docs_of(rows), spark.createDataFrame(labels, LABELS), {i: i % 6 == 0 for i in range(900)}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_rows(corpus):
    docs, labels, truth = corpus
    rows = toxicity.toxicity_report(docs, labels).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: r for r in rows}
    assert all(got[i]["held_out"] == held(i) for i in truth)
    tests = [i for i in truth if held(i)]
    assert sum(got[i]["predicted"] == truth[i] for i in tests) >= 0.97 * len(tests)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert got[5002]["predicted"] == 1 and not any(got[i]["predicted"] for i in (5000, 5001, 5003, None))
    assert got[None]["held_out"] is False


def test_held_out_labels_teach_nothing(corpus):
    from pyspark.sql import functions as F

    docs, labels, _ = corpus
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.toxicity_report(docs, x).collect()) for x in (labels, other))
    assert a == b


def test_filter_keeps_columns_and_clean_rows(corpus):
    docs, labels, truth = corpus
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {5000, 5001, 5003, None} <= ids and 5002 not in ids
    assert sum(i in ids for i, bad in truth.items() if bad) <= 3 and sum(i not in ids for i, bad in truth.items() if not bad) <= 3
    assert kept.select("score").first()[0] == 7


def plain_models(shared, rows):
    """Kneser-Ney as the module states it, over tokens of all texts and of (tokens, toxic) rows: evidence of words and of pairs."""
    import math
    from collections import Counter

    def less(n, d):
        return max(0.0, n - d[min(n, 3) - 1]) if n else 0.0

    s = Counter(w for text in shared for w in set(text))
    n = Counter(min(c, 5) for c in s.values())
    n1, n2, n3, n4 = (max(1, n[i]) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = [min(max(x, 0.5), i + 0.95) for i, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]
    every = sum(s.values())
    floor = (1 - sum(less(c, d) for c in s.values()) / every) / (len(s) + 1)
    big = (1.0, 2.0, 2.9)
    pair = [Counter(p for w, toxic in rows if toxic == c for p in set(zip(["", *w], w, strict=False))) for c in (1, 0)]
    word = [Counter(w for _, w in p) for p in pair]
    left = [sum(less(c, big) for c in k.values()) for k in word]
    lam = max(1 - x / sum(k.values()) for x, k in zip(left, word, strict=True))
    p1 = lambda c, w: (1 - lam) * less(word[c][w], big) / left[c] + lam * (less(s[w], d) / every + floor)
    words = {w: math.log(p1(0, w) / p1(1, w)) for w in {*word[0], *word[1]} if any(less(k[w], big) for k in word)}
    pairs = {}
    for v in {v for p in pair for v, _ in p}:
        own = [{w: n for (b, w), n in p.items() if b == v} for p in pair]
        kept = [sum(less(n, big) for n in k.values()) for k in own]
        if not any(kept):
            continue
        back = [1 - x / sum(k.values()) if k else 1.0 for x, k in zip(kept, own, strict=True)]
        if all(kept):
            back = [max(back)] * 2
        p2 = lambda c, w, own=own, kept=kept, back=back: ((1 - back[c]) * less(own[c].get(w, 0), big) / kept[c] if kept[c] else 0.0) + back[c] * p1(c, w)
        pairs |= {f"{v} {w}": math.log(p2(0, w) / p2(1, w)) for w in {*own[0], *own[1]} if any(less(k.get(w, 0), big) for k in own)}
    return words, pairs


def test_evidence_against_plain_models(corpus):
    docs, labels, truth = corpus
    model = toxicity.learn(docs, labels)
    texts = {r["doc_id"]: toxicity.tokens(r["text"]) for r in docs.dropDuplicates(["doc_id", "text"]).where("doc_id < 5000").collect()}
    every = [toxicity.tokens(r["text"]) for r in docs.collect() if r["text"] is not None]
    fit = [(texts[i], int(bad)) for i, bad in truth.items() if zlib.crc32(str(i).encode()) % 5 > 1]
    fit += [(texts[5], 0)] if zlib.crc32(b"5") % 5 > 1 else []  # a repeated row
    words, pairs = plain_models(every, fit)
    assert model.words == pytest.approx(words) and model.pairs == pytest.approx(pairs)
    assert set(MEAN) <= set(words) and min(words[m] for m in MEAN) > 1 and min(words.values()) < 0  # ordinary evidence stays


def test_features_are_normalised_by_length():
    m = toxicity.Model({"vile": 3.0, "kind": -1.0}, {"so vile": 5.0})
    one, four, sixteen, whole, *pair, length = m.features("so vile and kind")
    assert (one, four, sixteen, whole) == (3.0, 0.5, 0.125, 0.125) and pair[0] == 5.0 and pair[3] == 0.25 and length > 0
    assert m.features("vile " * 1000)[:4] == [3.0] * 4
    assert m.features(None) == m.features(" 	") == [0.0] * 9
    assert m.score("vile " * 1000) >= m.score("vile") > 0.5 > m.score("kind words") >= m.score("") - 1e-9


def test_opening_expressions(docs_of, spark, prose):
    """A phrase that only ever opens toxic texts is found, however long the text behind it."""
    r = random.Random(11)
    rows, labels = [], []
    for i in range(1300):
        bad = i % 4 == 0
        rows.append((i, ("vile rotten scum " if bad else "") + prose(r.randrange(40, 300), 7000 + i, 900)))
        labels.append((i, 1, int(bad), 0))
    rows += [(5000 + i, f"vile rotten scum {prose(20_000, 9000 + i, 900)}") for i in range(3)]
    got = {x["doc_id"]: x["predicted"] for x in toxicity.toxicity_report(docs_of(rows), spark.createDataFrame(labels, LABELS)).collect()}
    tests = [i for i in range(1300) if held(i)]
    found = [got[i] for i in tests if i % 4 == 0]
    assert sum(found) > 0.9 * len(found) and sum(got[i] for i in tests if i % 4) <= 0.02 * len(tests)
    assert all(got[5000 + i] for i in range(3))


def test_scores_are_spread(corpus):
    docs, labels, truth = corpus
    scores = {r["score"] for r in toxicity.toxicity_report(docs, labels).collect()}
    assert len(scores) > 0.8 * len(truth)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0, 0)], [(1, 1, 1, 0)]])
def test_without_both_classes(spark, docs_of, labels):
    rows = toxicity.toxicity_report(docs_of([(1, "a b"), (2, None)]), spark.createDataFrame(labels, LABELS)).collect()
    assert [r["predicted"] for r in rows] == [0, 0]
    assert toxicity.toxicity_report(docs_of([]), spark.createDataFrame(labels, LABELS)).count() == 0
