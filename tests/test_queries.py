"""Every query with SQL against DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from quillmark import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    return sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    got, want = core.QUERIES[name](spark, SF).toPandas(), duck.sql(core.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(core.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
