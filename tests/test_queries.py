"""Every query with SQL against DuckDB on the smallest tables; those without return rows."""

import numbers
from pathlib import Path

import duckdb
import pytest

from quern.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, numbers.Number) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    result = duck.sql(SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
