"""Each registered query runs on small tables, and those with SQL agree with it."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)) or (isinstance(v, int) and not isinstance(v, bool)):
        return round(float(v), 5)
    return None if v is None else str(v).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_agrees_with_sql(spark, sql, name):
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    mine = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=str)
    found = sql.execute(entry.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    theirs = sorted(([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=str)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(entry.QUERIES) - set(entry.ORACLES)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).columns
    entry.queries()[name](spark, DATA).count()
