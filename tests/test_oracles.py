"""Every query with SQL against the same SQL in DuckDB, on the smallest tables."""

import glob
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def shown(v):
    if v is None or v != v:
        return None
    if isinstance(v, (bool, str, bytes, bytearray)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([shown(x) for x in v])
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    told = tables.execute(entry.oracle_sql()[name])
    names = [x[0] for x in told.description]
    assert sorted(names) == columns
    at = [names.index(x) for x in columns]
    want = Counter(tuple(shown(r[i]) for i in at) for r in told.fetchall())
    assert Counter(tuple(shown(r[x]) for x in columns) for r in df.collect()) == want
