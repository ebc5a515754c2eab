"""Every query that has SQL gives, on the smallest test data, what DuckDB gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


SQL = {n: q for n, q in entry.oracle_sql().items() if not n.startswith("p") or n.startswith("p2_")}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, DATA)
    names = sorted(got.columns)
    want = db.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == names
    expected = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == expected
