"""Plans that grow with the input and with the rows they return, and their results on odd rows."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest import queries
from palimpsest.session import Session

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def alike(spark, tables: dict[str, tuple[str, list]], sql: str, duck: str | None = None):
    """The rows of a statement over small tables, which DuckDB returns too."""
    s, con = Session(spark), duckdb.connect()
    for name, (schema, rows) in tables.items():
        s.register(name, spark.createDataFrame(rows, schema))
        con.execute(f"CREATE TABLE {name} ({schema.replace('string', 'varchar')})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    found = sorted(map(repr, (tuple(r) for r in s.execute(sql).collect())))
    assert found == sorted(map(repr, con.execute(duck or sql).fetchall()))
    return found


SKIPPED = {
    "c": ("k bigint, b double", [(1, 1.0), (1, 5.0), (2, None), (None, 2.0), (3, 2.0), (3, 2.0), (4, -1.0)]),
    "o": ("i bigint, k bigint", [(10, 1), (11, 1), (12, 2), (13, 3), (14, None), (15, 9)]),
    "l": ("i bigint, p double", [(10, 2.0), (11, 4.5), (12, 9.0), (13, 2.0), (13, None), (14, 7.0)]),
}


@pytest.mark.parametrize(
    "where",
    [
        "EXISTS (SELECT 1 FROM o WHERE o.k = c.k AND EXISTS (SELECT 1 FROM l WHERE l.i = o.i AND l.p > c.b))",
        "NOT EXISTS (SELECT 1 FROM o WHERE o.k = c.k AND EXISTS (SELECT 1 FROM l WHERE l.i = o.i AND l.p > c.b))",
        "EXISTS (SELECT 1 FROM o WHERE (o.k = c.k OR o.i < c.b * 6) AND NOT EXISTS (SELECT 1 FROM l WHERE l.i = o.i AND l.p > c.b))",
        "(SELECT COUNT(*) FROM o WHERE o.k = c.k AND EXISTS (SELECT 1 FROM l WHERE l.i = o.i AND l.p > c.b)) < 1",
        "EXISTS (SELECT 1 FROM o WHERE o.k = c.k AND EXISTS (SELECT 1 FROM l WHERE l.i = o.i AND EXISTS (SELECT 1 FROM o AS x WHERE x.k = c.k AND l.p > c.b AND x.i >= o.i)))",
    ],
)
def test_correlation_through_queries(spark, where):
    assert alike(spark, SKIPPED, f"SELECT c.k, c.b FROM c WHERE {where}")


def test_correlation_through_queries_joins_by_keys(spark):
    plan = physical(queries.QUERIES["corr_skip_level"](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


DAYS = [f"2024-01-{d:02}" for d in range(1, 8)]
SPANS = {
    "p": ("k bigint, g string, s date, e date", [(i, "xyz"[i % 3] if i % 7 else None, dt.date.fromisoformat(DAYS[i % 4]) if i % 11 else None, dt.date.fromisoformat(DAYS[i % 4 + 1 + i % 3]) if i % 13 else None) for i in range(60)]),
    "r": ("k bigint, s timestamp, e timestamp", [(i, dt.datetime.fromisoformat(DAYS[i % 5]), dt.datetime.fromisoformat(DAYS[i % 5 + i % 3])) for i in range(40)] + [(40, None, None)]),
    "none": ("k bigint, s date, e date", []),
}


@pytest.mark.parametrize(("name", "word", "test"), queries.PERIODS)
def test_joins_of_periods(spark, name, word, test):
    assert alike(spark, SPANS, f"SELECT a.k, b.k, a.g FROM p AS a, p AS b WHERE PERIOD(a.s, a.e) {word} PERIOD(b.s, b.e)", f"SELECT a.k, b.k, a.g FROM p AS a, p AS b WHERE {test}")
    assert alike(spark, SPANS, f"SELECT p.g, COUNT(*) FROM p JOIN r ON [r.s, r.e] {word} [p.s, p.e] AND p.k > 3 WHERE r.k < 39 GROUP BY p.g", f"SELECT p.g, COUNT(*) FROM p JOIN r ON {test.replace('a.', 'r.').replace('b.', 'p.')} AND p.k > 3 WHERE r.k < 39 GROUP BY p.g")
    assert alike(spark, SPANS, f"SELECT COUNT(*) FROM r, none WHERE {{start: r.s, end: r.e}} {word} PERIOD(none.s, none.e)", "SELECT 0")
    assert alike(spark, SPANS, f"SELECT DISTINCT a.k FROM p AS a, r AS b WHERE a.k = b.k AND a.g = 'x' AND PERIOD(a.s, a.e) {word} PERIOD(b.s, b.e)", f"SELECT DISTINCT a.k FROM p AS a, r AS b WHERE a.k = b.k AND a.g = 'x' AND {test}") is not None
    assert alike(spark, SPANS, f"SELECT * FROM (SELECT k, PERIOD(s, e) AS w FROM p) AS a, (SELECT k AS j, s AS at FROM r) AS b WHERE a.w {word} b.at ORDER BY a.k LIMIT 0", "SELECT 1 LIMIT 0") == []


def test_instants_in_periods(spark):
    assert alike(spark, SPANS, "SELECT a.k, b.k FROM p AS a, r AS b WHERE PERIOD(a.s, a.e) CONTAINS b.s", "SELECT a.k, b.k FROM p AS a, r AS b WHERE a.s <= b.s AND a.e > b.s")
    assert alike(spark, SPANS, "SELECT a.k, b.k FROM p AS a, r AS b WHERE a.s PRECEDES PERIOD(b.s, b.e) AND EXISTS (SELECT 1 FROM p AS c WHERE c.k = b.k)", "SELECT a.k, b.k FROM p AS a, r AS b WHERE a.s <= b.s AND EXISTS (SELECT 1 FROM p AS c WHERE c.k = b.k)")


@pytest.mark.parametrize("name", ["period_overlaps", "period_contains", "period_succeeds", "period_precedes", "period_immediately_succeeds", "period_immediately_precedes"])
def test_joins_of_periods_lie_in_even_shares(spark, tmp_path, name):
    spark.range(2000).select((F.col("id") * 36).alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/same/supplier.parquet")
    spark.range(2000).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/mixed/supplier.parquet")
    for folder in ("same", "mixed"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/{folder}/supplier.parquet/*.parquet'")
        want = con.execute(f"SELECT COUNT(*), SUM(x * 7 + y) FROM ({queries.ORACLES[name]})").fetchone()
        df = queries.QUERIES[name](spark, f"{tmp_path}/{folder}")
        shares = df.groupBy(F.spark_partition_id().alias("i")).agg(F.count("*").alias("n"), F.sum(F.expr("x * 7 + y")).alias("s")).collect()
        assert (sum(r.n for r in shares), sum(r.s for r in shares) if shares else None) == want
        assert not shares or max(r.n for r in shares) < want[0] / 8


SETS = {
    "a": ("k bigint, x double", [(1, 1.0), (1, None), (2, 5.0), (3, 2.0), (None, 2.0), (4, 0.0), (5, 7.0)]),
    "b": ("k bigint, y bigint", [(1, 1), (1, 3), (2, None), (2, 5), (3, 2), (3, 2), (4, None), (None, 0)]),
}


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
def test_quantified(spark, op):
    for kind in ("ANY", "ALL"):
        for query in ("SELECT b.y FROM b WHERE b.k = a.k", "SELECT b.y FROM b", "SELECT b.y FROM b WHERE b.y IS NOT NULL", "SELECT b.y FROM b WHERE b.k > 90", "SELECT MAX(b.y) FROM b WHERE b.k = a.k GROUP BY b.k", "SELECT b.y FROM b WHERE b.k < a.k", "SELECT b.y FROM b WHERE b.k = a.k UNION ALL SELECT 2"):
            assert alike(spark, SETS, f"SELECT a.k, a.x, a.x {op} {kind} ({query}) AS r FROM a")
        alike(spark, SETS, f"SELECT a.k FROM a WHERE NOT a.x {op} {kind} (SELECT b.y FROM b WHERE b.k = a.k)")
        alike(spark, SETS, f"SELECT c.k, COUNT(*) FROM a AS c JOIN a ON a.x {op} {kind} (SELECT b.y FROM b WHERE b.k = a.k) GROUP BY c.k")
        alike(spark, SETS, f"SELECT SUM(CASE WHEN a.x {op} {kind} (SELECT b.y FROM b WHERE b.k = a.k) THEN 1 ELSE 0 END) FROM a")


def test_in_queries_as_values(spark):
    for query in ("SELECT b.y FROM b WHERE b.k = a.k", "SELECT b.y FROM b", "SELECT b.y FROM b WHERE b.y IS NOT NULL"):
        for word in ("IN", "NOT IN"):
            assert alike(spark, SETS, f"SELECT a.k, a.x, a.x {word} ({query}) AS r FROM a")
    assert "NestedLoop" not in physical(queries.QUERIES["in_subquery_null"](spark, SF))


def test_quantified_values_meet_no_rows(spark):
    """Each supplier meets one row of its nation, not all customers of it."""
    plan = physical(queries.QUERIES["quant_any"](spark, SF))
    assert "ExistenceJoin" not in plan and "min(c_" in plan
