"""The operators' queries against their SQL in DuckDB."""

import duckdb
import pytest

from pagequarry.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    got, want = QUERIES[name](spark, FOLDER).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert sorted(map(repr, got[want.columns].to_numpy().tolist())) == sorted(map(repr, want.to_numpy().tolist()))
