import random

import numpy as np
import pytest

import corpus_pipeline
from veristrand.llm import near_dedup, simhash
from veristrand.llm.common import min_labels, words_of


def plain_keep(rows, similarity=0.8):
    """doc_ids that stay, of rows with distinct ids."""
    rows = sorted(rows)
    w = [words_of(t, lower=True) for _, t in rows]
    sets = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set() for x in w]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    lab = min_labels(len(rows), *np.array(pairs, dtype=int).reshape(-1, 2).T)
    return [i for k, (i, _) in enumerate(rows) if lab[k] == k]


def edited(text, n, seed):
    w, r = text.split(), random.Random(seed)
    for i in r.sample(range(len(w)), n):
        w[i] = f"edit{r.random()}"
    return " ".join(w)


@pytest.mark.parametrize("chunk_rows", [1024, 5])
def test_stage_drops_copies_at_the_threshold(spark, docs_of, prose, monkeypatch, chunk_rows):
    monkeypatch.setattr(near_dedup, "CHUNK_ROWS", chunk_rows)  # small: groups are dealt out in chunks
    rows = [(i, prose(200, i)) for i in range(20)]
    for i in range(120):  # about 0.95 down to 0.6, chains included
        rows.append((100 + i, edited(random.Random(i).choice(rows)[1], i % 10, i)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "four words are one"), (904, "FOUR words are  one"), (905, "long " * 50_000)]
    docs = docs_of(rows)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == plain_keep(rows)


def test_pairs_at_the_threshold_are_candidates():
    """A thousand pairs of similarity 0.8: each shares a band and agrees in its sketch."""
    r = np.random.default_rng(1)
    for _ in range(1000):
        x = r.integers(0, 2**64, 1000, dtype=np.uint64)
        (one, a), (two, b) = near_dedup.bands(x[:900]), near_dedup.bands(x[100:])
        agreed = (np.frombuffer(a, dtype=np.uint8) == np.frombuffer(b, dtype=np.uint8)).sum()
        assert set(one) & set(two) and agreed >= near_dedup.AGREE and len(a) == near_dedup.BANDS * near_dedup.ROWS


def test_agreeing_rows():
    """Drawn in directly or over others, within buckets only; buckets of all sizes at once."""
    r = np.random.default_rng(2)
    for _ in range(40):
        sizes = r.integers(1, 40, 12)
        bucket = np.repeat(np.arange(12), sizes)
        sketch = r.integers(0, 3, (5, 96), dtype=np.uint8)[r.integers(0, 5, len(bucket))]
        noise = r.random(sketch.shape) < r.choice([0.05, 0.3, 0.5], len(bucket))[:, None]
        sketch = np.where(noise, r.integers(3, 9, sketch.shape), sketch).astype(np.uint8)
        agree = ((sketch[:, None] == sketch[None]).sum(axis=2) >= near_dedup.AGREE) & (bucket[:, None] == bucket)
        assert near_dedup.agreeing(bucket, sketch).tolist() == min_labels(len(bucket), *np.nonzero(agree)).tolist()


@pytest.mark.parametrize("bucket", [2048, 6])
def test_boilerplate_makes_no_candidates(spark, docs_of, prose, tmp_path, monkeypatch, bucket):
    """Texts that share over a quarter of their shingles meet in buckets, and none of those is a candidate."""
    from veristrand.llm.common import Scratch

    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    common = prose(90, 77)
    rows = [(i, f"{common} {prose(110, 5000 + i)}") for i in range(1500 if bucket > 100 else 150)]
    rows += [(9000 + i, rows[i][1] + " and more") for i in range(20)]
    marked = near_dedup._marked(docs_of(rows), 5).dropDuplicates(["fp"])
    met = marked.selectExpr("fp", "explode(bands) AS band").groupBy("band").count()
    assert sum(r["count"] for r in met.where("count > 2").collect()) > len(rows) / 50
    found = near_dedup._candidates(marked.select("fp", "bands", "sketch"), Scratch(spark, "test")).collect()
    by = {r["fp"]: r["doc_id"] % 9000 for r in marked.collect()}
    assert {tuple(sorted((by[r["a"]], by[r["b"]]))) for r in found} == {(i, i) for i in range(20)}


def test_null_ids_and_small_tables(docs_of, prose):
    t = prose(200, 1)
    kept = near_dedup.near_dedup(docs_of([(3, t), (2, t), (2, t), (None, t), (7, None), (8, "")]))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 2), (False, 7), (True, 0)]
    assert near_dedup.near_dedup(docs_of([])).count() == 0


def test_pivot_tables_name_candidates(spark, docs_of, prose, monkeypatch):
    """With no link from bands, copies within three bits are found by SimHash alone, and verified."""
    monkeypatch.setattr(near_dedup, "_candidates", lambda nodes, scratch: spark.createDataFrame([], "a long, b long"))
    rows = [(i, prose(400, i)) for i in range(30)]
    rows += [(100 + i, edited(rows[i][1], 1, i)) for i in range(30)]
    rows += [(200, None), (201, ""), (202, "one two three"), (203, "ONE two three")]
    marks = [simhash.majority(near_dedup.shingle_set(words_of(t, lower=True))) for _, t in rows]
    near = [i for i in range(30) if (marks[i] ^ marks[30 + i]).bit_count() <= simhash.RADIUS]
    kept = {r["doc_id"] for r in near_dedup.near_dedup(docs_of(rows)).collect()}
    assert len(near) > 5 and kept == {i for i, _ in rows} - {100 + i for i in near} - {201, 203}
