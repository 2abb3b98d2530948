"""Every registered query of the core against its SQL in DuckDB, on the smallest tables."""

import datetime as dt
import importlib
import os

import pytest

SF = os.environ.get("CODEQUARRY_TEST_DATA", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
MODULES = [importlib.import_module(f"codequarry.plans.{m}") for m in ("general", "graph", "retrieval", "ingest", "sources")]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in SQL:
        return
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
