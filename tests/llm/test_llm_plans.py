import pytest

from veristrand.llm import mixing
from veristrand.llm.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op2_low_discrepancy_mix", "op4_license_scan"])
def test_native(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_mix_is_native(spark, sf_dir):
    text = plan(mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    assert "Python" not in text and "Arrow" not in text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_products(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
