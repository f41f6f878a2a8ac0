"""Versioned tables: changes, system time, transactions, views, assertions, compaction."""

import pyarrow as pa
import pytest

from palimpsest.session import Session, SqlError
from palimpsest.sources.versioned import Conflict


@pytest.fixture()
def db(spark, tmp_path):
    return Session(spark, str(tmp_path))


def rows(db, sql, params=None):
    return sorted(tuple(r) for r in db.execute(sql, params).collect())


def stamp(db):
    return f"TIMESTAMP '{db.last.isoformat()}'"


def test_history(db):
    assert db.execute("INSERT INTO t (a, b) VALUES (103, 'x'), (104, 'y')") == 2
    first = stamp(db)
    assert db.execute("UPDATE t SET a = 101 WHERE b = 'x'") == 1
    second = stamp(db)
    assert db.execute("DELETE FROM t WHERE b = 'y'") == 1
    assert rows(db, "SELECT a, b FROM t") == [(101, "x")]
    assert rows(db, f"SELECT a FROM t FOR SYSTEM_TIME AS OF {first}") == [(103,), (104,)]
    assert rows(db, f"SELECT a FROM t FOR SYSTEM_TIME AS OF {second}") == [(101,), (104,)]
    assert rows(db, f"SELECT a FROM t FOR SYSTEM_TIME FROM {first} TO {second}") == [(103,), (104,)]
    assert rows(db, f"SELECT a FROM t FOR SYSTEM_TIME BETWEEN {first} AND {second}") == [(101,), (103,), (104,)]
    assert rows(db, "SELECT a FROM t FOR SYSTEM_TIME ALL WHERE system_time.end < 9999-01-01") == [(103,), (104,)]
    db.compact("t")
    assert rows(db, "SELECT a FROM t FOR SYSTEM_TIME ALL") == [(101,), (103,), (104,)]
    assert db.execute("ERASE FROM t WHERE a > 102") == 2
    assert rows(db, "SELECT a FROM t FOR SYSTEM_TIME ALL") == [(101,)]
    db.compact("t")
    assert rows(db, "SELECT a, b FROM t") == [(101, "x")]


def test_schema_comes_with_the_rows(db):
    db.execute("INSERT INTO t {a: 2, b: 3}, {a: 1, c: 'x'}")
    db.execute("INSERT INTO t {a: 'text', d: 2001-01-01}")
    assert db.execute("SELECT * FROM t").columns == ["a", "b", "c", "d"]
    assert rows(db, "SELECT TYPEOF(a), COUNT(*) FROM t GROUP BY TYPEOF(a)") == [("integer", 2), ("text", 1)]
    assert rows(db, "SELECT column_name FROM information_schema.columns WHERE table_name = 't'") == [("a",), ("b",), ("c",), ("d",)]


def test_update_paths_unset_and_patch(db):
    db.execute("INSERT INTO t {id: 1, o: {x: 1, y: [1, 2]}}")
    db.execute("UPDATE t SET o.z = 5, $.o.y[0] = 9 WHERE id = 1")
    assert rows(db, "SELECT CAST(o.z AS INTEGER), CAST(o.y[0] AS INTEGER) FROM t") == [(5, 9)]
    db.execute("UPDATE t UNSET o.x PATCH {name: 'n'}")
    assert rows(db, "SELECT TYPEOF(o.x), name FROM t") == [("null", "n")]


def test_upsert(db):
    db.execute("INSERT INTO t (k, v) VALUES (1, 10), (2, 20), (NULL, 30)")
    assert db.execute("INSERT INTO t (k, v) VALUES (1, 1), (3, 3), (NULL, 5) ON CONFLICT (k) DO UPDATE SET v = v + excluded.v") == 3
    assert sorted(map(str, rows(db, "SELECT COALESCE(k, -1), v FROM t"))) == ["(-1, 35)", "(1, 11)", "(2, 20)", "(3, 3)"]
    assert db.execute("INSERT INTO t (k, v) VALUES (1, 0), (4, 4) ON CONFLICT (k) DO NOTHING") == 1
    with pytest.raises(SqlError, match="duplicated on conflict"):
        db.execute("INSERT INTO t (k, v) VALUES (7, 0), (7, 4) ON CONFLICT (k) DO NOTHING")
    with pytest.raises(SqlError, match="Cannot update the on conflict columns"):
        db.execute("INSERT INTO t (k, v) VALUES (1, 0) ON CONFLICT (k) DO UPDATE SET k = 3")


def test_transactions(db, spark, tmp_path):
    db.execute("INSERT INTO t (a) VALUES (1)")
    db.execute("BEGIN")
    db.execute("INSERT INTO t (a) VALUES (2)")
    db.execute("SAVEPOINT s")
    db.execute("DELETE FROM t")
    assert rows(db, "SELECT a FROM t") == []
    db.execute("ROLLBACK TO s")
    assert rows(db, "SELECT a FROM t") == [(1,), (2,)]
    other = Session(spark, str(tmp_path))
    assert rows(other, "SELECT a FROM t") == [(1,)]
    other.execute("INSERT INTO t (a) VALUES (3)")
    with pytest.raises(Conflict):
        db.execute("COMMIT")
    assert rows(db, "SELECT a FROM t") == [(1,), (3,)]
    db.execute("BEGIN")
    db.execute("DELETE FROM t")
    db.execute("ROLLBACK")
    assert rows(db, "SELECT a FROM t") == [(1,), (3,)]


def test_assertions_and_views(db):
    db.execute("INSERT INTO users {email: 'a'}")
    db.execute("CREATE ASSERTION unique_email CHECK (1 >= ALL (SELECT COUNT(*) FROM users GROUP BY email))")
    with pytest.raises(SqlError, match="Constraint failed: unique_email"):
        db.execute("INSERT INTO users {email: 'a'}")
    assert rows(db, "SELECT COUNT(*) FROM users") == [(1,)]
    db.execute("DROP ASSERTION unique_email; INSERT INTO users {email: 'a'}")
    db.execute("CREATE VIEW v (mail, n) AS SELECT email, COUNT(*) FROM users GROUP BY email")
    assert rows(db, "SELECT * FROM v") == [("a", 2)]
    db.execute("DROP VIEW v")
    with pytest.raises(SqlError, match="Unknown table"):
        db.execute("SELECT * FROM v")


def test_many(db):
    db.execute("INSERT INTO t (a, b) VALUES (?, ?)", [[1, "x"], [2, "y"]], many=True)
    db.execute("INSERT INTO t {a: :a, b: :b}", pa.table({"a": [3], "b": ["z"]}), many=True)
    assert rows(db, "SELECT a, b FROM t") == [(1, "x"), (2, "y"), (3, "z")]


def test_damaged_manifest_blocks_no_writer(db, spark, tmp_path):
    db.execute("INSERT INTO t (a) VALUES (1)")
    db.execute("INSERT INTO t (a) VALUES (2)")
    newest = sorted((tmp_path / "manifest").glob("*.json"))[-1]
    newest.write_text(newest.read_text()[: newest.stat().st_size // 2])
    for p in (tmp_path / "manifest").glob(".*.crc"):
        p.unlink()
    other = Session(spark, str(tmp_path))
    assert rows(other, "SELECT a FROM t") == [(1,)]
    assert other.execute("INSERT INTO t (a) VALUES (3)") == 1
    assert rows(Session(spark, str(tmp_path)), "SELECT a FROM t") == [(1,), (3,)]
    assert not list((tmp_path / "manifest").glob("*.tmp"))


def test_writers_at_once(spark, tmp_path):
    store = Session(spark, str(tmp_path)).store
    first, second = store.latest(), store.latest()
    now = __import__("datetime").datetime.now(__import__("datetime").timezone.utc)
    store.publish(first, now)
    with pytest.raises(Conflict):
        store.publish(second, now)
    assert store.latest()["tx"] == 1


def test_vacuum_after_erase(db, tmp_path):
    import datetime as dt

    db.execute("INSERT INTO t (a, secret) VALUES (1, 'abc'), (2, 'xyz')")
    db.execute("ERASE FROM t WHERE a = 2")
    db.compact("t")
    old = {p.name for p in (tmp_path / "data").iterdir()}
    assert db.vacuum() == 0 and {p.name for p in (tmp_path / "data").iterdir()} == old
    assert db.vacuum(dt.timedelta(0)) > 0
    assert rows(db, "SELECT a, secret FROM t FOR SYSTEM_TIME ALL") == [(1, "abc")]
    assert len([p for p in (tmp_path / "data").iterdir() if not p.name.startswith(".")]) == 1 < len(old)
    db.execute("INSERT INTO t (a) VALUES (5)")
    assert rows(db, "SELECT a FROM t") == [(1,), (5,)]
