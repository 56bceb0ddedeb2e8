"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from plinth import queries as own

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(rows):
    return sorted([tuple("" if v is None else f"{v:.8g}" if isinstance(v, float) else str(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, duck, name):
    df = own.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in own.ORACLES:
        assert rows
        return
    found = duck.sql(own.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert plain(rows) == plain([tuple(r[i] for i in at) for r in found.fetchall()])
