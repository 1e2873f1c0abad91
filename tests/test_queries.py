"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from millrace.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    return str(v.normalize()) if isinstance(v, Decimal) else round(v, 6) if isinstance(v, float) else v


def rows(records, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert name in ORACLE_SQL
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert rows(got, [df.columns.index(n) for n in names]) == rows(want, range(len(names)))
