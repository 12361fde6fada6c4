"""Every asset query against its SQL in DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from tidewall.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not there")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return v.date()
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def _key(row):
    return [(v is not None, str(type(v)), round(v, 3) if isinstance(v, float) else str(v)) for v in row]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    cursor = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(([_plain(r[columns.index(c)]) for c in order] for r in cursor.fetchall()), key=_key)
    got = sorted(([_plain(v) for v in r] for r in df.select(*[f"`{c}`" for c in order]).collect()), key=_key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)) for a, b in zip(g, w, strict=True)), (g, w)
