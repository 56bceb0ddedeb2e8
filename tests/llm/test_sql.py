"""The SQL of the operators that SQL can express gives their queries' rows."""

import duckdb
import pytest
from helpers import fixture, frame

from plinth.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tmp_path, name):
    docs = frame(spark, [r for r in fixture() if r[1] is None or len(r[1]) < 5000], extra=False)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    pages = [(i, f"http://h{i % 3}.com/{i}", "<p>same</p>" if i % 4 == 0 else None if i % 7 == 0 else f"<p>{i}</p>") for i in range(40)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    found = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted([tuple(map(str, r)) for r in df.select(columns).collect()]) == sorted([tuple(str(r[i]) for i in at) for r in found.fetchall()])
