"""Queries that SQL can express give its rows."""

import duckdb
import pytest
from tracewarden.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.ORACLES)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
