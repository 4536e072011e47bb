"""Every query of the catalogue against its SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from pagequarry.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    try:
        return round(float(v), 6) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    got = rows(QUERIES[name](spark, FOLDER).toPandas())
    assert got == rows(con.execute(SQL[name]).df())
    assert got


def test_all_but_folds_have_sql():
    assert set(QUERIES) - set(SQL) == {"table_grids", "ink_blobs", "page_ink", "recognised_lines", "page_figures"}
