"""Every registered query with SQL against DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


LIBRARY = [n for n in entry.queries() if not n.startswith("op") or not n[2:3].isdigit()]


@pytest.mark.parametrize("name", [n for n in LIBRARY if n != "pipeline"])
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in entry.oracle_sql():
        assert got
        return
    out = con.sql(entry.oracle_sql()[name])
    assert sorted(out.columns) == columns
    at = [list(out.columns).index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
