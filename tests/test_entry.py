"""The registered queries against their DuckDB twins."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from palimpsest import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0 if math.isfinite(v) else str(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in queries.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_as_duckdb(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(plain(r)) for r in found.fetchall())
    assert sorted(repr(plain(tuple(r))) for r in df.select(*names).collect()) == want


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_filters_reach_the_scan(spark):
    plan = queries.QUERIES["tpch_q6"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "Python" not in plan and "l_orderkey" not in plan
