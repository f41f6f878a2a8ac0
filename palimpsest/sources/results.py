"""Results as JSON arrays, JSON-LD, NDJSON, CSV and Arrow.

Rows become text inside Spark, so a large result streams partition by partition, or is written by the executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

from palimpsest.dialect.lexer import SqlError
from palimpsest.functions import scalar as fx
from palimpsest.plans.types import E, quote, text

JSON, LD, ND, CSV = "application/json", "application/ld+json", "application/x-ndjson", "text/csv"
ARROW_FILE, ARROW_STREAM = "application/vnd.apache.arrow.file", "application/vnd.apache.arrow.stream"
KINDS = (JSON, LD, ND, CSV, ARROW_FILE, ARROW_STREAM)
MIXED = "multipart/mixed"
VOCABULARY = "urn:palimpsest:"
SAFE = 2**53 - 1
_TAGGED = r'\{"@type":"xsd:[A-Za-z0-9]+","@value":("(?:[^"\\]|\\.)*")\}'


def json_cell(e: E, typed: bool) -> str:
    """JSON text of a value: dates and the like as typed objects or as plain text."""
    doc = fx.to_doc(e)
    if e.type == "integer":
        big = f"concat('{{\"@type\":\"xsd:integer\",\"@value\":\"', {doc}, '\"}}')" if typed else f"concat('\"', {doc}, '\"')"
        doc = f"CASE WHEN abs(CAST({e.sql} AS DECIMAL(38,0))) > {SAFE} THEN {big} ELSE {doc} END"
    elif e.type == "real":
        doc = f"CASE WHEN isnan({e.sql}) OR abs({e.sql}) = CAST('Infinity' AS DOUBLE) THEN 'null' ELSE {doc} END"
    elif not typed and e.type not in ("text", "boolean", "null"):
        doc = f"regexp_replace({doc}, {text(_TAGGED)}, '$1')"
    return f"coalesce({doc}, 'null')"


def csv_cell(e: E) -> str:
    s = f"base64({e.sql})" if e.type == "blob" else fx.as_text(e)
    return f"coalesce(CASE WHEN {s} RLIKE {text('[",\\r\\n]')} THEN concat('\"', replace({s}, '\"', '\"\"'), '\"') ELSE {s} END, '')"


def lines(df: DataFrame, types: list, kind: str) -> DataFrame:
    """One column ``line``: a JSON or CSV text for each row."""
    names, inner = df.columns, [f"c{i}_" for i in range(len(df.columns))]
    cells = [E(quote(n), t) for n, t in zip(inner, types, strict=True)]
    if kind == CSV:
        sql = f"concat_ws(',', {', '.join(csv_cell(e) for e in cells)})"
    elif kind == JSON:
        sql = f"concat('[', concat_ws(',', {', '.join(json_cell(e, False) for e in cells)}), ']')"
    else:
        pairs = ", ".join(f"concat({text(json.dumps(n, ensure_ascii=False) + ':')}, {json_cell(e, kind == LD)})" for n, e in zip(names, cells, strict=True))
        sql = f"concat('{{', concat_ws(',', {pairs}), '}}')"
    return df.toDF(*inner).selectExpr(f"{sql} AS line")


class Pieces:
    """A file to write to, whose bytes are taken off as they come."""

    closed = False

    def __init__(self):
        self.held: list[bytes] = []

    def write(self, data) -> int:
        self.held.append(bytes(data))
        return len(self.held[-1])

    def flush(self) -> None:
        pass

    def taken(self) -> bytes:
        out, self.held = b"".join(self.held), []
        return out


def arrow(df: DataFrame, kind: str) -> Iterator[bytes]:
    """An Arrow file or stream. Executors encode batches, and the driver holds one partition's at a time."""
    import pyarrow as pa

    def encode(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as writer:
                writer.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part"])

    sink, writer = Pieces(), None
    new = pa.ipc.new_file if kind == ARROW_FILE else pa.ipc.new_stream
    for row in df.mapInArrow(encode, "part binary").toLocalIterator(prefetchPartitions=True):
        with pa.ipc.open_stream(row.part) as reader:
            writer = writer or new(sink, reader.schema)
            for b in reader:
                writer.write_batch(b)
        yield sink.taken()
    writer = writer or new(sink, df.limit(0).toArrow().schema)
    writer.close()
    yield sink.taken()


def chunks(df: DataFrame, types: list, kind: str) -> Iterator[bytes]:
    """The result in ``kind``, piece by piece."""
    if kind in (ARROW_FILE, ARROW_STREAM):
        yield from arrow(df, kind)
        return
    if kind not in KINDS:
        raise SqlError(f"Unknown result type: {kind}")
    head, between, tail = {
        JSON: ("[", ",", "]\n"),
        LD: (f'{{"@context":{{"xsd":"http://www.w3.org/2001/XMLSchema#","@vocab":"{VOCABULARY}"}},"@graph":[', ",", "]}\n"),
        ND: ("", "\n", "\n"),
        CSV: (",".join('"' + n.replace('"', '""') + '"' for n in df.columns) + "\r\n", "\r\n", "\r\n"),
    }[kind]
    yield head.encode()
    first = True
    for row in lines(df, types, kind).toLocalIterator(prefetchPartitions=True):
        yield (("" if first else between) + row.line).encode()
        first = False
    if not (first and kind in (ND, CSV)):
        yield tail.encode()
