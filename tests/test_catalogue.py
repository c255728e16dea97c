"""Every query with SQL gives what DuckDB gives."""

import glob
import os

import duckdb
import pytest
from tickloom.plans.catalogue import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    q = db.sql(ORACLE_SQL[name])
    assert sorted(q.columns) == columns
    want = sorted((tuple(plain(dict(zip(q.columns, r, strict=True))[c]) for c in columns) for r in q.fetchall()), key=repr)
    assert got == want


def test_arithmetic_unary_of_odd_values(spark, tmp_path):
    """Null, both zeros, negative values, and ties of the rounding."""
    values = "[NULL, 0.0, -0.0, 0.004, -0.04, 0.05, 0.25, -0.25, 0.35, 2.675, -12.34, 25.0, 560.21, 123456789.12]::DOUBLE[]"
    file, c = str(tmp_path / "events.parquet"), duckdb.connect()
    c.sql(f"copy (select event_id, timestamp '2024-01-01' as ts, 1::bigint as user_id, 'view' as event_type, value, '' as props from (select unnest({values}) as value, unnest(range(14)) as event_id)) to '{file}'")
    c.sql(f"create view events as select * from '{file}'")
    q = c.sql(ORACLE_SQL["arithmetic_unary"])
    got = QUERIES["arithmetic_unary"](spark, str(tmp_path)).select(*q.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, q.fetchall()))
