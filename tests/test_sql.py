"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from quern import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def spelled(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: spelled(x) for k, x in sorted(v.items())}
    return [spelled(x) for x in v] if isinstance(v, (list, tuple)) else v


def compared(spark, query, sql, folder):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = sorted(repr([spelled(r[c]) for c in cols]) for r in df.collect())
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(repr([spelled(x[names.index(c)]) for c in cols]) for x in r.fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, name):
    compared(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], DATA)
