"""The queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from quillmark.llm import queries as Q

SF = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = Q.QUERIES[name](spark, SF).toPandas(), con.sql(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).to_numpy().tolist()), key=str)
    assert rows(got) == rows(want)


def test_registered(spark):
    import __spark_entry__ as e

    assert set(Q.QUERIES) | {"pipeline"} <= set(e.queries()) and set(Q.ORACLES) <= set(e.oracle_sql())
