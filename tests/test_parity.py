"""Every query with SQL gives the rows DuckDB gives on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lekhya.operators.queries import oracle_sql, queries

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def plain(v):
    return None if v is None else ("nan" if math.isnan(v) else repr(round(v, 9) + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    df = queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    result = duck.execute(oracle_sql()[name])
    have = [d[0] for d in result.description]
    assert sorted(have) == columns
    at = [have.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == want
