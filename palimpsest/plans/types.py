"""Types of the dialect, and lowered expressions that carry them.

A type is a name (null boolean integer real text blob date time timestamp interval doc) or a tuple: ("array", type),
("object", ((key, type), ..)), ("map", type). ``doc`` is any value as canonical JSON text; tagged objects stand for
dates, times and the like.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

INTERVAL = "struct<months:int,days:int,nanos:bigint>"


class E(NamedTuple):
    sql: str
    type: object
    const: object = None  # the Python value of a literal
    is_const: bool = False


def of_spark(t: T.DataType):
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(t, T.DecimalType):
        return "integer" if t.scale == 0 else "real"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "real"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.BinaryType):
        return "blob"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(t, T.ArrayType):
        return ("array", of_spark(t.elementType))
    if isinstance(t, T.MapType):
        return ("map", of_spark(t.valueType))
    if isinstance(t, T.StructType):
        if [f.name for f in t] == ["months", "days", "nanos"]:
            return "interval"
        return ("object", tuple((f.name, of_spark(f.dataType)) for f in t))
    if isinstance(t, T.NullType):
        return "null"
    if "time" in t.simpleString():
        return "time"
    raise TypeError(f"no dialect type for {t.simpleString()}")


_DDL = {"null": "void", "boolean": "boolean", "integer": "bigint", "real": "double", "text": "string", "blob": "binary", "date": "date", "time": "time(6)", "timestamp": "timestamp", "interval": INTERVAL, "doc": "string"}


def ddl(t) -> str:
    """The Spark type that holds ``t``; nulls inside others are kept as strings, which files can hold."""
    if isinstance(t, str):
        return _DDL[t]
    if t[0] == "array":
        return f"array<{_inner(t[1])}>"
    if t[0] == "map":
        return f"map<string,{_inner(t[1])}>"
    return "struct<" + ",".join(f"{quote(k)}:{_inner(x)}" for k, x in t[1]) + ">"


def _inner(t) -> str:
    return "string" if t == "null" else ddl(t)


def name_of(t) -> str:
    return t if isinstance(t, str) else {"map": "object"}.get(t[0], t[0])


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A Spark string literal."""
    body = "".join({"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}.get(c, c) for c in value)
    return f"'{body}'"


NUMERIC = ("integer", "real")
TEMPORAL = ("date", "timestamp")


def unify(a, b):
    """The type that holds both: numbers widen, dates become timestamps, anything else that differs becomes doc."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if a in NUMERIC and b in NUMERIC:
        return "real"
    if a in TEMPORAL and b in TEMPORAL:
        return "timestamp"
    if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0] == "array":
        inner = a[1] if b[1] == "null" else b[1] if a[1] == "null" else None
        return ("array", inner) if inner else "doc"
    return "doc"
