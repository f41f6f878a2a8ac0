"""Result formats, HTTP, WebSocket and streams."""

import base64
import json
import os
import socket
import urllib.error
import urllib.request

import pyarrow as pa
import pytest

from palimpsest.session import Session
from palimpsest.sources import results
from palimpsest.sources.server import Server
from palimpsest.streaming.ingest import into_table

SQL = "SELECT 1 AS a, 'x\"y' AS b, 2001-01-02 AS c, [1, NULL] AS d, {k: 2001-01-01T00:00:00Z} AS e, NULL AS f, 9007199254740993 AS g, P1DT2H AS h, 1.5 AS i, x'41' AS j"


@pytest.fixture()
def db(spark, tmp_path):
    return Session(spark, f"{tmp_path}/db")


def test_formats(db):
    text = lambda kind: b"".join(db.stream(db.execute(SQL), kind)).decode()
    assert json.loads(text(results.JSON)) == [[1, 'x"y', "2001-01-02", [1, None], {"k": "2001-01-01T00:00:00.000000Z"}, None, "9007199254740993", "P1DT2H", 1.5, "QQ=="]]
    row = json.loads(text(results.LD))["@graph"][0]
    assert row["c"] == {"@type": "xsd:date", "@value": "2001-01-02"} and row["g"]["@type"] == "xsd:integer" and row["h"] == {"@type": "xsd:duration", "@value": "P1DT2H"} and row["f"] is None
    assert json.loads(text(results.ND))["e"] == {"k": "2001-01-01T00:00:00.000000Z"}
    assert text(results.CSV).startswith('"a","b","c"') and '1,"x""y",2001-01-02,"[1,null]"' in text(results.CSV)
    for kind, reader in ((results.ARROW_FILE, pa.ipc.open_file), (results.ARROW_STREAM, pa.ipc.open_stream)):
        assert reader(b"".join(db.stream(db.execute("SELECT 1 AS a"), kind))).read_all().to_pydict() == {"a": [1]}
    assert json.loads(b"".join(db.stream(db.execute("INSERT INTO t (a) VALUES (1), (2)")))) == [[2]]
    assert b"".join(db.stream(db.execute("SELECT a FROM t WHERE a > 5"), results.JSON)) == b"[]\n"


def test_rows_as_python_values(db):
    import datetime as dt

    assert list(db.rows("SELECT 1 AS a UNION ALL SELECT 'x' UNION ALL SELECT 2001-01-02 UNION ALL SELECT [1, 'y']")) == [(1,), ("x",), (dt.date(2001, 1, 2),), ([1, "y"],)]
    assert list(db.rows("SELECT {a: 1, b: [{c: 2001-01-02}]} AS o, [1, 2] AS v, NULL AS n")) == [({"a": 1, "b": [{"c": dt.date(2001, 1, 2)}]}, [1, 2], None)]
    db.execute("INSERT INTO m {x: 1, t: 'a'}, {x: 'one', t: {k: 2.5}}")
    assert sorted(map(str, db.rows("SELECT x, t FROM m"))) == ["('one', {'k': 2.5})", "(1, 'a')"]
    assert list(db.rows("DELETE FROM m WHERE x = 1")) == [(1,)]


def test_arrow_comes_in_parts(db):
    for kind, reader in ((results.ARROW_FILE, pa.ipc.open_file), (results.ARROW_STREAM, pa.ipc.open_stream)):
        parts = list(db.stream(db.execute("SELECT g.v, 'x' AS t FROM GENERATE_SERIES(1, 3000000) AS g (v)"), kind))
        assert len(parts) > 3 and reader(b"".join(parts)).read_all().num_rows == 3_000_000
        assert reader(b"".join(db.stream(db.execute("SELECT 1 AS a WHERE FALSE"), kind))).read_all().num_rows == 0


def test_written_by_executors(db, tmp_path, spark):
    db.write(db.execute("SELECT g.v FROM GENERATE_SERIES(1, 100) AS g (v)"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").selectExpr("sum(v)").first()[0] == 5050


def test_http_and_websocket(db, spark, tmp_path):
    server = Server(lambda: Session(spark, f"{tmp_path}/db"), port=0, user="u", password="p").start()
    token = "Basic " + base64.b64encode(b"u:p").decode()

    def ask(path, body=None, **headers):
        r = urllib.request.Request(f"http://127.0.0.1:{server.port}{path}", body, {"Authorization": token} | {k.replace("_", "-"): v for k, v in headers.items()})
        try:
            with urllib.request.urlopen(r, timeout=60) as got:
                return got.status, got.read()
        except urllib.error.HTTPError as err:
            return err.code, err.read()

    try:
        assert ask("/sql", b"INSERT INTO t (a) VALUES (1), (2)", Content_Type="application/sql")[0] == 201
        assert ask("/sql?q=SELECT%20a%20FROM%20t%20ORDER%20BY%20a") == (200, b"[[1],[2]]\n")
        assert ask("/sql", json.dumps({"q": "SELECT ? AS x", "p": [5]}).encode(), Content_Type="application/json", Accept="application/x-ndjson") == (200, b'{"x":5}\n')
        assert ask("/sql?q=DELETE%20FROM%20t")[0] == 400 and ask("/sql?q=SELEC")[0] == 400
        assert ask("/sql?q=SELECT%201", Accept="image/png")[0] == 406 and ask("/sql", b"x", Content_Type="image/png")[0] == 415
        assert ask("/sql?q=SELECT%201", Authorization="Basic x")[0] == 401 and ask("/sql", b"", Content_Type="application/json")[0] == 422
        assert b"palimpsest_queries_total" in ask("/metrics")[1]
        sink = pa.BufferOutputStream()
        batch = pa.table({"a": [7, 8]})
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_table(batch)
        part = lambda name, data, kind="text/plain": f'--XX\r\nContent-Disposition: form-data; name="{name}"\r\nContent-Type: {kind}\r\n\r\n'.encode() + data + b"\r\n"
        body = part("q", b"INSERT INTO t (a) VALUES (:a)") + part("m", b"true") + part("p", sink.getvalue().to_pybytes(), "application/vnd.apache.arrow.stream") + b"--XX--\r\n"
        assert ask("/sql", body, Content_Type="multipart/form-data; boundary=XX")[0] == 201
        status, body = ask("/sql", b"DELETE FROM t WHERE a > 6; SELECT COUNT(*) AS n FROM t", Content_Type="application/sql", Accept="multipart/mixed")
        assert status == 201 and body.count(b"--palimpsest-part\r\n") == 2 and b'"@graph":[{"result":2}]' in body and b'"@graph":[{"n":2}]' in body
        assert ask("/sql?q=SELECT%20SQRT(-1)")[0] == 400
        with socket.create_connection(("127.0.0.1", server.port), timeout=60) as s:
            s.sendall(f"GET /sql HTTP/1.1\r\nHost: x\r\nAuthorization: {token}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: dGhlIHNhbXBsZSBub25jZQ==\r\n\r\n".encode())
            f = s.makefile("rb")
            head = b"".join(iter(f.readline, b"\r\n"))
            assert b"s3pPLMBiTxaQ9kYGzzhZRbK+xOo=" in head

            def call(q):
                data, mask = json.dumps({"jsonrpc": "2.0", "id": 1, "method": "sql", "params": {"q": q}}).encode(), os.urandom(4)
                s.sendall(bytes([129, 254]) + len(data).to_bytes(2, "big") + mask + bytes(x ^ mask[i % 4] for i, x in enumerate(data)))
                n = f.read(2)[1]
                return json.loads(f.read(int.from_bytes(f.read(2), "big") if n == 126 else n))

            pad = " " * 80
            assert call("BEGIN" + pad)["result"]["@graph"] == [{"result": True}]
            assert call("DELETE FROM t" + pad)["result"]["@graph"] == [{"result": 2}]
            assert call("ROLLBACK" + pad)["result"]["@graph"] == [{"result": True}]
            assert call("SELECT COUNT(*) AS n FROM t" + pad)["result"]["@graph"] == [{"n": 2}]
            assert "Unknown table" in call("SELECT * FROM nope" + pad)["error"]["message"]
    finally:
        server.stop()


def test_stream_into_table(db, spark, tmp_path):
    spark.range(100).selectExpr("id AS k", "id % 3 AS g").write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema("k long, g long").parquet(f"{tmp_path}/in")
        into_table(stream, db, "t", f"{tmp_path}/ckpt", availableNow=True).awaitTermination(120)
    assert [tuple(r) for r in db.execute("SELECT COUNT(*), SUM(k) FROM t").collect()] == [(100, 4950)]
