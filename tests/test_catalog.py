"""Every query with SQL is compared with DuckDB on the small tables; the others must run and keep their schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("KERBLINE_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in entry.oracle_sql():
        return
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["record_id", "reason"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
