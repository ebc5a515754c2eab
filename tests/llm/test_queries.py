"""Queries of the training-data operators give, on the smallest test data, what their SQL gives."""

import os

import duckdb
import pytest
from test_oracle import DATA, plain

from memlake.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    """Exactly: vectors as few as these are compared in full."""
    got = QUERIES[name](spark, DATA)
    want = db.execute(SQL[name])
    columns = [c[0] for c in want.description]
    names = sorted(got.columns)
    assert sorted(columns) == names
    expected = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == expected
