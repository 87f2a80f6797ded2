"""Queries that SQL can express, beside DuckDB on whole tables."""

import os

import duckdb
import pytest

from lodestone.llm import queries as Q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        path = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    df = Q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(Q.ORACLES[name])
    names = [c[0] for c in found.description]
    theirs = sorted(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
    assert sorted(names) == columns and sorted(tuple(r[c] for c in columns) for r in df.collect()) == theirs
