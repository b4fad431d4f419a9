"""Plans stay the ones wanted: no product of rows, pruned scans, pushed filters, no Python where none is needed."""

import pytest

from veristrand.plans.queries import QUERIES

#: A semi-join with one row that says whether there is any edge.
ONE_ROW = {"graph_endpoints"}
#: Steps that are sequential by nature or not relational.
PYTHON = {"answers_source", "lease_replay", "fenced_writes", "owned_leases", "json_repair"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_products(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert name in ONE_ROW or "NestedLoopJoin" not in text
    if name not in PYTHON:
        assert "Python" not in text and "InPandas" not in text and "Arrow" not in text


def test_scans_are_pruned(spark, sf_dir):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(QUERIES["content_dedupe"](spark, sf_dir))
    assert "struct<doc_id:bigint>" in plan(QUERIES["status_histogram"](spark, sf_dir))


def test_documents_are_scanned_twice(spark, sf_dir):
    """Once for lengths, once for texts; what reads members again reads their checkpoint."""
    from veristrand.plans import frames

    scans = lambda df: plan(df).count("documents.parquet]")
    assert scans(frames.members(spark, sf_dir)) == 2
    assert [scans(QUERIES[n](spark, sf_dir)) for n in ("evidence_verify", "evidence_by_kind", "evidence_page_types", "reduce_root")] == [0] * 4


def test_verification_joins_on_keys(spark, sf_dir):
    text = plan(QUERIES["evidence_verify"](spark, sf_dir))
    assert "SortMergeJoin [paper" in text or "BroadcastHashJoin [paper" in text


def test_filters_are_pushed(spark, sf_dir):
    text = plan(QUERIES["fenced_writes"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(user_id)" in text
