"""Every query against its SQL on the smallest tables; skipped where they aren't there."""

from __future__ import annotations

import os

import duckdb
import pytest

from sparkloom.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(x):
    return round(x, 6) if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = [tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    result = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["q_predicates_cmp"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull" in plan and "o_custkey" not in plan.split("ReadSchema")[1]


def test_entry_point(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
