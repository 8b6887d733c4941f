"""Every query with SQL against that SQL, on the smallest test data; the others end."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
CORE = [name for part in entry.PARTS for name in part.queries]


@pytest.fixture(scope="session")
def sql():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return lambda q: con.sql(q)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def compare(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    query = entry.oracle_sql().get(name)
    if query is None:
        return
    rel = sql(query)
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    expected = [tuple(r[i] for i in order) for r in rel.fetchall()]
    by = lambda r: tuple(f"{x:.4g}" if isinstance(x, float) else repr(x) for x in r)
    got, expected = sorted(map(tuple, got), key=by), sorted(expected, key=by)
    assert len(got) == len(expected)
    assert all(same(x, y) for a, b in zip(got, expected) for x, y in zip(a, b))


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sql, name):
    compare(spark, sql, name)


def test_entry(spark, monkeypatch):
    monkeypatch.setattr(entry.search, "search_top10", lambda s, d: d)
    assert entry.entry(spark).endswith("sf0.001")
