"""The registered queries: DuckDB twins where they exist, and the pipeline against its stages."""

import hashlib

import duckdb
import pandas as pd
import pytest
from test_near_dedup import plain_keep
from test_substring_dedup import brute

import corpus_pipeline
from veristrand.llm import mixing, queries, toxicity
from veristrand.llm.common import words_of


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(name, spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), c.sql(queries.ORACLES[name]).df()
    cols = sorted(want.columns)
    a, b = (x[cols].fillna("~").sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op") and n[2].isdigit()]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in e.queries()


def test_pipeline(spark, sf_dir):
    """Stage by stage against plain restatements of what each keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = spark.createDataFrame(stage(spark, rows, sf_dir).toPandas(), docs.schema)
        assert rows.columns == docs.columns
        kept.append([(r["doc_id"], r["text"]) for r in rows.collect()])
    toxic = {r["doc_id"] for r in toxicity.toxicity_report(docs, labels).collect() if r["predicted"]}
    clean = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in toxic]
    assert sorted(kept[0]) == sorted(clean)

    stay = set(plain_keep(clean))
    single = [(i, t) for i, t in clean if i in stay]
    assert sorted(kept[1]) == sorted(single)

    left = {i: (n - gone, sha) for i, n, gone, sha in brute(single)}
    assert {i: (len(words_of(t)), hashlib.sha256(b" ".join(words_of(t))).hexdigest()) for i, t in kept[2]} == {i: x for i, x in left.items() if x[0]}

    taken: dict = {}
    for i, t in kept[3]:
        taken.setdefault(i, []).append(len(words_of(t)))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    cut = spark.createDataFrame([(i, t, "en", source[i], 0) for i, t in kept[2]], docs.schema)
    assert {i: sum(n) for i, n in taken.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix_report(cut).collect() if r["taken"]}

    check_packed(corpus_pipeline.run(spark, sf_dir).collect(), {i: len(n) for i, n in taken.items()})


def check_packed(out, passes):
    """Sequences hold each pass of each document once, from its start, and nothing else."""
    starts: dict = {}
    for r in out:
        n = len(r["ids"])
        assert n == len(r["segments"]) == sum(s > 0 for s in r["segments"]) and (n == 2048 or n & (n - 1) == 0)
        assert len(r["doc_ids"]) == len(r["row_ids"]) == len(r["starts"]) == max(r["segments"])
        for d, row, at in zip(r["doc_ids"], r["row_ids"], r["starts"], strict=True):
            starts.setdefault((d, row), []).append(at)
    assert all(len(set(x)) == len(x) and 0 in x for x in starts.values())
    got: dict = {}
    for d, _ in starts:
        got[d] = got.get(d, 0) + 1
    assert got == passes


def test_pipeline_of_odd_rows(spark, docs_of, prose, tmp_path):
    """Nulls, empty and very long texts, repeats, ties, clashing names, and an empty table."""
    long, mild = prose(100_000, 9), prose(150, 3)
    rows = [(i, prose(20 + i, i), "en", f"s{i % 3}") for i in range(40)]
    rows += [(50, None), (51, ""), (52, long, None, "s1"), (3, rows[3][1], "en", "s0"), (53, mild, "en", None), (54, mild, "en", "s2"), (None, prose(60, 8), "en", "s1"), (None, prose(60, 8), "en", "s1")]
    rows += [(60 + i, f"{prose(30, 60 + i)} vile vile rot", "en", "s1") for i in range(20)]
    docs = docs_of(rows)
    spark.createDataFrame([(i, 1, int(i >= 60)) for i in [*range(40), *range(60, 80)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame([tuple(r) for r in stage(spark, at, str(tmp_path)).collect()], docs.schema)
        kept.append(at.collect())
    assert all(r["size"] == 7 and r["digest"] == 7 for rs in kept for r in rs)
    assert {r["doc_id"] for r in kept[0]} >= {*range(40), 50, 51, 52, 53, 54, None}
    assert [sum(r["doc_id"] == 3 for r in rs) for rs in kept[:2]] == [2, 1] and not {51, 54} & {r["doc_id"] for r in kept[1]}
    passes: dict = {}
    for r in kept[3]:
        assert r["text"]
        passes[r["doc_id"]] = passes.get(r["doc_id"], 0) + 1
    assert 52 in passes and max(n for d, n in passes.items() if d is not None) <= 3
    check_packed(corpus_pipeline.run(spark, str(tmp_path)).collect(), passes)
    empty = f"{tmp_path}/empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
