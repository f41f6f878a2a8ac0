"""The engine over HTTP (GET and POST /sql, /metrics) and WebSocket (JSON-RPC with transactions)."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import threading
from collections import Counter
from collections.abc import Callable, Iterator
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain, islice
from urllib.parse import parse_qs, urlsplit

from palimpsest.dialect.lexer import SqlError
from palimpsest.dialect.parser import parse, parse_expression
from palimpsest.session import Session
from palimpsest.sources import results
from palimpsest.sources.versioned import Conflict

#: Statements that leave the database as it is.
READS = ("query",)
TRANSACTIONS = ("begin", "commit", "rollback", "savepoint", "release", "rollback_to")
_WEBSOCKET = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"  # fixed by RFC 6455


def literal(text: str):
    """A parameter: JSON, or a literal of the dialect."""
    try:
        return json.loads(text)
    except ValueError:
        return value_of(parse_expression(text))


def value_of(e):
    import datetime as dt

    if e[0] == "lit":
        read = {"date": dt.date.fromisoformat, "time": dt.time.fromisoformat, "ts": dt.datetime.fromisoformat}.get(e[2])
        return read(e[1]) if read else e[1]
    if e[0] == "array":
        return [value_of(x) for _, x in e[1]]
    if e[0] == "object":
        return {k: value_of(x) for _, k, x in e[1]}
    raise SqlError("Parameters must be literals")


def form(kind: str, body: bytes) -> dict:
    """The fields of a multipart form; an Arrow part stays bytes, others are text."""
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + body)
    out = {}
    for part in message.iter_parts():
        data, arrow = part.get_payload(decode=True), part.get_content_type().startswith("application/vnd.apache.arrow")
        out[part.get_param("name", header="Content-Disposition")] = data if arrow else data.decode()
    return out


class Server:
    """``connect`` makes a session; each WebSocket has its own, and HTTP requests share one, one at a time."""

    def __init__(self, connect: Callable[[], Session], host: str = "127.0.0.1", port: int = 3803, user: str | None = None, password: str = ""):
        self.connect, self.shared, self.lock, self.counts = connect, connect(), threading.RLock(), Counter()
        self.token = "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode() if user else None
        outer = self

        class Handler(_Handler):
            server_of = outer

        self.http = ThreadingHTTPServer((host, port), Handler)
        self.port = self.http.server_port

    def start(self) -> Server:
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self.http.shutdown()
        self.http.server_close()

    def call(self, session: Session, message: dict) -> dict:
        """One JSON-RPC request: method ``sql``, params q, p, m by name or place."""
        out = {"jsonrpc": "2.0", "id": message.get("id")}
        if message.get("method") != "sql":
            return out | {"error": {"code": -32601, "message": "Method not found"}}
        p = message.get("params") or {}
        p = dict(zip("qpm", p, strict=False)) if isinstance(p, list) else p
        if not isinstance(p.get("q"), str):
            return out | {"error": {"code": -32602, "message": "Invalid params"}}
        try:
            with self.lock:
                result = session.execute(p["q"], p.get("p"), bool(p.get("m")))
                body = b"".join(session.stream(result, results.LD))
        except Exception as err:
            return out | {"error": {"code": -32000, "message": str(err).splitlines()[0]}}
        return out | {"result": json.loads(body)}


class _Broken(Exception):
    """An answer that has begun cannot go on."""


_BOUNDARY = "palimpsest-part"


def mixed(session: Session, answers: list) -> Iterator[bytes]:
    """Each statement's answer as a part of JSON-LD."""
    for answer in answers:
        yield f"--{_BOUNDARY}\r\nContent-Type: {results.LD}\r\n\r\n".encode()
        yield from session.stream(answer, results.LD)
        yield b"\r\n"
    yield f"--{_BOUNDARY}--\r\n".encode()


class _Handler(BaseHTTPRequestHandler):
    server_of: Server
    protocol_version = "HTTP/1.1"

    def log_message(self, *args) -> None:
        pass

    def reply(self, status: int, body: bytes = b"", kind: str = "text/plain", **headers: str) -> None:
        self.send_response(status)
        for k, v in {"Content-Type": kind, "Content-Length": str(len(body)), **headers}.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self) -> None:
        url = urlsplit(self.path)
        if self.server_of.token and self.headers.get("Authorization") != self.server_of.token:
            return self.reply(401, WWW_Authenticate="Basic")
        if self.headers.get("Upgrade", "").lower() == "websocket":
            return self.websocket()
        if url.path == "/metrics":
            return self.reply(200, "".join(f"palimpsest_{k}_total {n}\n" for k, n in sorted(self.server_of.counts.items())).encode())
        if url.path != "/sql":
            return self.reply(404)
        return self.sql({k: v[0] for k, v in parse_qs(url.query).items()}, read_only=True)

    def do_POST(self) -> None:
        if self.server_of.token and self.headers.get("Authorization") != self.server_of.token:
            return self.reply(401, WWW_Authenticate="Basic")
        url = urlsplit(self.path)
        if url.path != "/sql":
            return self.reply(404)
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        kind = (self.headers.get("Content-Type") or "application/sql").partition(";")[0].strip()
        args = {k: v[0] for k, v in parse_qs(url.query).items()}
        if kind == "application/sql":
            args["q"] = body.decode()
        elif kind == "application/x-www-form-urlencoded":
            args |= {k: v[0] for k, v in parse_qs(body.decode()).items()}
        elif kind == "multipart/form-data":
            args |= form(self.headers["Content-Type"], body)
        elif kind in (results.JSON, results.LD):
            try:
                args |= json.loads(body)
            except ValueError:
                return self.reply(422)
        else:
            return self.reply(415)
        return self.sql(args, read_only=False)

    def sql(self, args: dict, read_only: bool) -> None:
        wanted = [a.partition(";")[0].strip() for a in (self.headers.get("Accept") or "*/*").split(",")]
        kind = next((results.JSON if a in ("*/*", "application/*") else a for a in wanted if a in (*results.KINDS, results.MIXED, "*/*", "application/*")), None)
        if kind is None:
            return self.reply(406)
        if not isinstance(args.get("q"), str):
            return self.reply(422)
        own = self.server_of
        own.counts["queries"] += 1
        try:
            p = literal(args["p"]) if isinstance(args.get("p"), str) else args.get("p")
            statements = parse(args["q"])
            if any(s.kind in TRANSACTIONS for s in statements):
                raise SqlError("Explicit transactions not supported")
            changes = any(s.kind not in READS for s in statements)
            if changes and read_only:
                raise SqlError("GET does not change the database")
            with own.lock:
                result = own.shared.execute(args["q"], p, args.get("m") in (True, "true"))
                parts = own.shared.stream(result, kind) if kind != results.MIXED else mixed(own.shared, list(own.shared.answers))
                self.stream(201 if changes else 200, parts, kind if kind != results.MIXED else f"{kind}; boundary={_BOUNDARY}")
        except Conflict:
            return self.reply(503)
        except (ConnectionError, _Broken):
            self.close_connection = True
        except Exception as err:
            own.counts["errors"] += 1
            return self.reply(400, (str(err).splitlines() or [""])[0].encode() + b"\n")
        return None

    def stream(self, status: int, parts: Iterator[bytes], kind: str) -> None:
        """Answer in chunks as the rows come. What fails before the first row is an error; later, the connection breaks."""
        first = b"".join(islice(parts, 3))  # at most a part's head, the format's head and a row
        chunked = self.request_version >= "HTTP/1.1"
        if not chunked:
            return self.reply(status, first + b"".join(parts), kind)
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Transfer-Encoding", "chunked")
        self.end_headers()
        try:
            for data in chain([first], parts):
                if data:
                    self.wfile.write(f"{len(data):x}\r\n".encode() + data + b"\r\n")
            self.wfile.write(b"0\r\n\r\n")
        except Exception as err:
            raise _Broken from err
        return None

    def websocket(self) -> None:
        key = self.headers.get("Sec-WebSocket-Key", "") + _WEBSOCKET
        self.send_response(101)
        for k, v in {"Upgrade": "websocket", "Connection": "Upgrade", "Sec-WebSocket-Accept": base64.b64encode(hashlib.sha1(key.encode()).digest()).decode()}.items():
            self.send_header(k, v)
        self.end_headers()
        session, self.close_connection = self.server_of.connect(), True
        whole = b""
        while head := self.rfile.read(2):
            last, code, size = head[0] & 128, head[0] & 15, head[1] & 127
            if size > 125:
                size = struct.unpack(">H" if size == 126 else ">Q", self.rfile.read(2 if size == 126 else 8))[0]
            mask = self.rfile.read(4) if head[1] & 128 else b"\0" * 4
            data = bytes(x ^ mask[i % 4] for i, x in enumerate(self.rfile.read(size)))
            if code == 8:
                return self.frame(8, b"")
            if code == 9:
                self.frame(10, data)
                continue
            whole += data
            if last and code in (0, 1, 2):
                try:
                    answer = self.server_of.call(session, json.loads(whole))
                except ValueError:
                    answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Parse error"}}
                whole = b""
                self.frame(1, json.dumps(answer).encode())
        return None

    def frame(self, code: int, data: bytes) -> None:
        n = len(data)
        size = bytes([n]) if n < 126 else struct.pack(">BH", 126, n) if n < 65536 else struct.pack(">BQ", 127, n)
        self.wfile.write(bytes([128 | code]) + size + data)
        self.wfile.flush()

