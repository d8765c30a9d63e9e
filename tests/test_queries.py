"""Each query with SQL gives the rows that DuckDB gives; the others give rows."""

import os

import pytest

from tracewright.run_queries import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    return con


def plain(frame, columns):
    def text(v):
        if v is None or v != v:
            return ""
        if hasattr(v, "item"):
            v = v.item()
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(text(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = db.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert plain(got, columns) == plain(want, columns)
