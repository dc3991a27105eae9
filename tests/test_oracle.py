"""Every query with oracle SQL gives DuckDB's rows; every other one runs."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for name in os.listdir(DATA):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if "llm" not in QUERIES[k].__module__))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in SQL:
        want = duck.sql(SQL[name])
        order = [want.columns.index(c) for c in sorted(want.columns)]
        assert sorted(df.columns) == sorted(want.columns)
        assert rows == Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
