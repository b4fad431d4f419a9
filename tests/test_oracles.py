"""Every registered query of the evidence engine against its DuckDB twin."""

import duckdb
import pandas as pd
import pytest

from veristrand.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(x):
    if x is None or x is pd.NA or isinstance(x, float) and x != x:
        return "~"
    return f"{float(x):.9g}" if isinstance(x, int | float) and not isinstance(x, bool) else str(x)


def table(df):
    df = df[sorted(df.columns)].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def test_each_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, sf_dir, duck):
    got = table(QUERIES[name](spark, sf_dir).toPandas())
    want = table(duck.sql(ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["paper", "kind", "items", "pages"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
