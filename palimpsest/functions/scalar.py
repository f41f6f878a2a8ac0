"""Scalar functions and operators as Spark SQL over typed arguments."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from palimpsest.dialect.lexer import SqlError, duration
from palimpsest.plans.types import NUMERIC, TEMPORAL, E, ddl, name_of, quote, text, unify

NULL = E("NULL", "null", None, True)


def null_of(t) -> str:
    return f"CAST(NULL AS {ddl(t)})" if t != "null" else "NULL"


def literal(v, kind: str | None = None) -> E:
    """A Python value as a literal."""
    import datetime as dt
    import uuid

    if v is None:
        return NULL
    if isinstance(v, bool):
        return E("true" if v else "false", "boolean", v, True)
    if isinstance(v, int):
        if not -(2**63) <= v < 2**63:
            return E(f"CAST('{v}' AS DECIMAL(38,0))", "integer", v, True)
        return E(f"{v}L" if v != -(2**63) else "(-9223372036854775807L - 1L)", "integer", v, True)
    if isinstance(v, float):
        return E(f"{v!r}D" if abs(v) < float("inf") else f"CAST('{v}' AS DOUBLE)", "real", v, True)
    if isinstance(v, (bytes, bytearray)):
        return E(f"X'{bytes(v).hex()}'", "blob", v, True)
    if isinstance(v, dt.datetime):
        return E(f"TIMESTAMP'{v.isoformat()}'", "timestamp", v, True)
    if isinstance(v, dt.date):
        return E(f"DATE'{v.isoformat()}'", "date", v, True)
    if isinstance(v, dt.time):
        return E(f"TIME'{v.isoformat()}'", "time", v, True)
    if isinstance(v, tuple) and len(v) == 3 and kind in (None, "interval"):
        m, d, n = v
        return E(f"named_struct('months', {int(m)}, 'days', {int(d)}, 'nanos', {int(n)}L)", "interval", v, True)
    if isinstance(v, uuid.UUID):
        v = str(v)
    if isinstance(v, (list, tuple)):
        return array_of([literal(x) for x in v])
    if isinstance(v, dict):
        if "@value" in v and "@type" in v:
            return tagged_literal(v)
        return object_of([(str(k), literal(x)) for k, x in v.items()])
    return E(text(str(v)), "text", str(v), True)


def tagged_literal(v: dict) -> E:
    import base64

    kind, x = v["@type"].rpartition(":")[2], v["@value"]
    if kind in ("date",):
        return E(f"DATE{text(x)}", "date", None, True)
    if kind == "dateTime":
        return E(f"TIMESTAMP{text(x)}", "timestamp", None, True)
    if kind == "time":
        return E(f"TIME{text(x)}", "time", None, True)
    if kind == "duration":
        return literal(duration(x), "interval")
    if kind == "base64Binary":
        return literal(base64.b64decode(x))
    if kind == "integer":
        return literal(int(x))
    raise SqlError(f"Invalid typed value: {v}")


# -- documents


def to_doc(e: E) -> str:
    """Canonical JSON of a value; null stays null."""
    s, t = e.sql, e.type
    if t == "doc":
        return s
    if t == "null":
        return "CAST(NULL AS STRING)"
    if t in ("boolean", "integer", "real"):
        return f"CAST({s} AS STRING)"
    if t == "text":
        return f"CASE WHEN {s} IS NOT NULL THEN substring(to_json(named_struct('v', {s})), 6, length(to_json(named_struct('v', {s}))) - 6) END"
    if t in ("date", "time", "timestamp", "blob", "interval"):
        kind = {"date": "xsd:date", "time": "xsd:time", "timestamp": "xsd:dateTime", "blob": "xsd:base64Binary", "interval": "xsd:duration"}[t]
        value = {"timestamp": f"date_format({s}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")", "blob": f"base64({s})", "interval": iso_interval(s)}.get(t, f"CAST({s} AS STRING)")
        return f"concat('{{\"@type\":\"{kind}\",\"@value\":\"', {value}, '\"}}')"
    if t[0] == "array":
        inner = to_doc(E("x_", t[1]))
        return f"concat('[', array_join(transform({s}, x_ -> coalesce({inner}, 'null')), ','), ']')"
    if t[0] == "map":
        inner = to_doc(E("x_.value", t[1]))
        key = to_doc(E("x_.key", "text"))
        return f"concat('{{', array_join(transform(array_sort(map_entries({s}), (a_, b_) -> CASE WHEN a_.key < b_.key THEN -1 WHEN a_.key > b_.key THEN 1 ELSE 0 END), x_ -> concat({key}, ':', coalesce({inner}, 'null'))), ','), '}}')"
    parts = []
    for k, x in sorted(t[1]):
        inner = "'null'" if x == "null" else to_doc(E(f"{s}.{quote(k)}", x))
        parts.append(f"concat({text(json.dumps(k, ensure_ascii=False) + ':')}, {inner})")
    if not parts:
        return f"CASE WHEN {s} IS NOT NULL THEN '{{}}' END"
    return f"CASE WHEN {s} IS NOT NULL THEN concat('{{', array_join(filter(array({', '.join(parts)}), x_ -> x_ IS NOT NULL), ','), '}}') END"


def from_doc(s: str, t) -> str:
    """The value of a document as ``t``; null if it is of another type."""
    if t in NUMERIC:
        return f"try_cast({s} AS {ddl(t)})"
    if t == "boolean":
        return f"CASE {s} WHEN 'true' THEN true WHEN 'false' THEN false END"
    if t == "text":
        return f"CASE WHEN {s} LIKE '\"%' THEN from_json(concat('{{\"v\":', {s}, '}}'), 'v STRING').v END"
    if t in ("date", "timestamp", "time"):
        return f"try_cast(get_json_object({s}, '$[\\'@value\\']') AS {ddl(t)})"
    if t == "blob":
        return f"unbase64(get_json_object({s}, '$[\\'@value\\']'))"
    if isinstance(t, tuple) and t[0] == "array" and t[1] in ("integer", "real", "text", "boolean"):
        return f"from_json({s}, '{ddl(t)}')"
    return null_of(t)


def doc(e: E) -> E:
    return E(to_doc(e), "doc")


class Path(NamedTuple):
    """Where an access with constant steps leads: a document column and a variant path. Scalars there need no Python."""

    base: str
    steps: str


def scalar(e: E, t: str) -> str:
    """The value of the document ``e`` as a number, text or boolean; null if it is of another type."""
    if not isinstance(e.const, Path) or t not in (*NUMERIC, "text", "boolean"):
        return from_doc(e.sql, t)
    v = f"variant_get(try_parse_json({e.const.base}), {text(e.const.steps)}, 'variant')"
    kinds = {"text": "= 'STRING'", "boolean": "= 'BOOLEAN'"}.get(t, "RLIKE '^(BIGINT|DOUBLE|DECIMAL.*)$'")
    return f"CASE WHEN schema_of_variant({v}) {kinds} THEN try_variant_get(try_parse_json({e.const.base}), {text(e.const.steps)}, '{ddl(t)}') END"


def onward(e: E, step: tuple) -> Path | None:
    """The path after one more constant step, if variants can follow it."""
    old = e.const if isinstance(e.const, Path) else Path(e.sql, "$")
    if step[0] == "key" and not set(step[1]) & set("\"'\\]"):
        return Path(old.base, f'{old.steps}["{step[1]}"]')
    if step[0] == "index" and step[1].is_const and isinstance(step[1].const, int) and step[1].const >= 0:
        return Path(old.base, f"{old.steps}[{step[1].const}]")
    return None


def cast_to(e: E, t) -> str:
    """``e`` as the wider type ``t``."""
    if e.type == t:
        return e.sql
    if t == "doc":
        return to_doc(e)
    return f"CAST({e.sql} AS {ddl(t)})"


def array_of(items: list[E]) -> E:
    t = "null"
    for x in items:
        t = unify(t, x.type) if t in ("null", x.type) or x.type == "null" else "doc"
    if t == "doc":
        parts = ", ".join(f"concat('[false,', coalesce({to_doc(x)}, 'null'), ']')" for x in items)
        return E(f"pl_array(concat('[', concat_ws(',', {parts}), ']'))", "doc")
    if t == "null":
        return E(f"array({', '.join('CAST(NULL AS STRING)' for _ in items)})", ("array", "text" if items else "null"))
    return E(f"array({', '.join(cast_to(x, t) for x in items)})", ("array", t))


def object_of(entries: list[tuple[str, E]]) -> E:
    last = dict(entries)
    if not last:
        return E("'{}'", "doc")
    cells = ", ".join(f"{text(k)}, {x.sql if x.type != 'null' else 'CAST(NULL AS STRING)'}" for k, x in last.items())
    return E(f"named_struct({cells})", ("object", tuple((k, x.type) for k, x in last.items())))


def access(e: E, step: tuple) -> E:
    """One access step; ``step`` is ("key", name) ("index", E) ("wild",) ("deep", E or None)."""
    t, s = e.type, e.sql
    kind = step[0]
    if kind == "index" and step[1].is_const and isinstance(step[1].const, str):
        kind, step = "key", ("key", step[1].const)
    if t == "null":
        return NULL
    if kind == "key" and isinstance(t, tuple):
        if t[0] == "object":
            found = dict(t[1]).get(step[1])
            return E(f"{s}.{quote(step[1])}", found) if found is not None else NULL
        if t[0] == "map":
            return E(f"try_element_at({s}, {text(step[1])})", t[1])
        inner = access(E("x_", t[1]), step)
        if inner.type == "null":
            return E("array()", ("array", "null"))
        return E(f"filter(transform({s}, x_ -> {inner.sql}), x_ -> x_ IS NOT NULL)", ("array", inner.type))
    if kind == "index" and isinstance(t, tuple) and t[0] == "array":
        i = step[1]
        if i.is_const and isinstance(i.const, int):
            return E(f"try_element_at({s}, {i.const + 1 if i.const >= 0 else i.const})", t[1])
        if i.type == "integer":
            return E(f"try_element_at({s}, CAST(CASE WHEN {i.sql} >= 0 THEN {i.sql} + 1 ELSE {i.sql} END AS INT))", t[1])
    if kind == "index" and t in ("boolean", "integer", "real", "text", "date", "time", "timestamp", "blob", "interval"):
        return E(f"CASE WHEN {step[1].sql} = 0 THEN {s} END", t)
    if kind == "wild" and isinstance(t, tuple) and t[0] == "array":
        return e
    if kind == "wild" and isinstance(t, tuple) and t[0] == "map":
        return E(f"map_values({s})", ("array", t[1]))
    if kind == "wild" and isinstance(t, str) and t != "doc":
        return E("array()", ("array", "null"))
    if kind == "key" and isinstance(t, str) and t != "doc":
        return NULL
    path = step[1] if kind == "key" else None
    if kind == "key":
        steps = text(json.dumps([["key", path]]))
    elif kind == "wild":
        steps = text('[["wild"]]')
    else:
        arg = step[1]
        inner = "'null'" if arg is None else f"coalesce({to_doc(arg)}, 'null')"
        steps = f"concat('[[\"{kind}\",', {inner}, ']]')"
    return E(f"pl_access({to_doc(e)}, {steps})", "doc", onward(e, step) if t == "doc" else None)


# -- intervals and time


def iso_interval(s: str) -> str:
    """ISO 8601 text of an interval struct."""
    part = lambda x, unit: f"CASE WHEN {x} <> 0 THEN concat(CAST({x} AS STRING), '{unit}') ELSE '' END"
    sec = f"{s}.nanos % 60000000000"
    seconds = f"CASE WHEN {sec} <> 0 THEN concat(regexp_replace(CAST(CAST({sec} AS DECIMAL(20,0)) / 1000000000 AS STRING), '\\\\.?0+$', ''), 'S') ELSE '' END"
    day = "".join(f", {part(x, u)}" for x, u in ((f"({s}.months DIV 12)", "Y"), (f"({s}.months % 12)", "M"), (f"{s}.days", "D")))
    clock = f"{part(f'({s}.nanos DIV 3600000000000)', 'H')}, {part(f'({s}.nanos DIV 60000000000 % 60)', 'M')}, {seconds}"
    return f"CASE WHEN {s}.months = 0 AND {s}.days = 0 AND {s}.nanos = 0 THEN 'PT0S' ELSE concat('P'{day}, CASE WHEN {s}.nanos <> 0 THEN concat('T', {clock}) ELSE '' END) END"


def calendar(s: str) -> str:
    return f"make_interval(0, {s}.months, 0, {s}.days, 0, 0, CAST({s}.nanos AS DECIMAL(20,0)) / 1000000000)"


def micros(e: E) -> str:
    if e.type == "time":
        return f"time_to_micros({e.sql})"
    return f"unix_micros(CAST({e.sql} AS TIMESTAMP))"


def nanos_struct(s: str) -> str:
    return f"CASE WHEN {s} IS NOT NULL THEN named_struct('months', 0, 'days', 0, 'nanos', {s}) END"


def shift(e: E, i: E, sign: str) -> E:
    """Date, timestamp or time plus or minus an interval: a date stays one unless the interval has a time of day."""
    if e.type == "time":
        return E(f"({e.sql} {sign} make_dt_interval(0, 0, 0, CAST({i.sql}.nanos AS DECIMAL(20,0)) / 1000000000))", "time")
    moved = f"(CAST({e.sql} AS TIMESTAMP) {sign} {calendar(i.sql)})"
    if e.type == "date" and i.is_const and not i.const[2]:
        return E(f"CAST({moved} AS DATE)", "date")
    return E(moved, "timestamp")


# -- numbers


def number(e: E) -> E:
    """The operand of an arithmetic operator: what is not a number counts as 0."""
    if e.type in NUMERIC:
        return e
    if e.type == "null":
        return e
    if e.type == "doc":
        return E(f"CASE WHEN {e.sql} IS NULL THEN NULL ELSE coalesce({scalar(e, 'real')}, 0D) END", "real")
    return E(f"CASE WHEN {e.sql} IS NULL THEN NULL ELSE 0L END", "integer")


def both_null(a: E, b: E) -> bool:
    return a.type == "null" or b.type == "null"


def whole(e: E) -> str:
    """The floored operand of a bit operator."""
    n = number(e)
    return n.sql if n.type == "integer" else f"CAST(floor({n.sql}) AS BIGINT)"


def arithmetic(op: str, a: E, b: E) -> E:
    if op == "+" and a.type == "interval" and b.type in (*TEMPORAL, "time"):
        a, b = b, a
    if op in "+-" and b.type == "interval" and a.type in (*TEMPORAL, "time"):
        return shift(a, b, op)
    if op in "+-" and a.type == b.type == "interval":
        if op == "+":
            return E(f"named_struct({', '.join(f"'{f}', {a.sql}.{f} + {b.sql}.{f}" for f in ('months', 'days', 'nanos'))})", "interval")
        key = lambda s: f"(({s}.months * 30L + {s}.days) * 86400000000000L + {s}.nanos)"
        parts = ", ".join(f"'{f}', CASE WHEN {key(a.sql)} < {key(b.sql)} THEN {b.sql}.{f} - {a.sql}.{f} ELSE {a.sql}.{f} - {b.sql}.{f} END" for f in ("months", "days", "nanos"))
        return E(f"named_struct({parts})", "interval")
    if op == "-" and a.type in TEMPORAL and b.type in TEMPORAL:
        return E(nanos_struct(f"(({micros(a)} - {micros(b)}) * 1000L)"), "interval")
    if op == "-" and a.type == b.type == "time":
        return E(nanos_struct(f"abs(({micros(a)} - {micros(b)}) * 1000L)"), "interval")
    if both_null(a, b):
        return NULL
    if op in ("<<", ">>"):
        x, n = whole(a), whole(b)
        left, right = ("shiftleft", "shiftright") if op == "<<" else ("shiftright", "shiftleft")
        return E(f"CASE WHEN {n} >= 0 THEN {left}({x}, CAST({n} AS INT)) ELSE {right}({x}, CAST(-({n}) AS INT)) END", "integer")
    if op in ("&", "|"):
        return E(f"({whole(a)} {op} {whole(b)})", "integer")
    a, b = number(a), number(b)
    t = "integer" if a.type == b.type == "integer" else "real"
    if op == "/":
        if t == "integer":
            return E(f"CASE WHEN {b.sql} <> 0 THEN {a.sql} DIV {b.sql} END", t)
        return E(f"try_divide(CAST({a.sql} AS DOUBLE), CAST({b.sql} AS DOUBLE))", t)
    if op == "%":
        return E(f"try_mod({a.sql}, {b.sql})", t)
    return E(f"({a.sql} {op} {b.sql})", t)


def math(fn: str, *, domain: str | None = None):
    """A double function of one number; ``domain`` is a condition on {0} without which the result would be complex."""

    def build(a: E) -> E:
        if a.type == "null":
            return NULL
        s = f"CAST({number(a).sql} AS DOUBLE)"
        call = f"{fn}({s})"
        if domain:
            call = f"CASE WHEN {s} IS NULL THEN NULL WHEN {domain.format(s)} THEN {call} ELSE raise_error('Complex number as result') END"
        return E(call, "real")

    return build


def logarithm(fn: str):
    def build(a: E) -> E:
        if a.type == "null":
            return NULL
        s = f"CAST({number(a).sql} AS DOUBLE)"
        return E(f"CASE WHEN {s} = 0 THEN NULL WHEN {s} < 0 THEN raise_error('Complex number as result') ELSE {fn}({s}) END", "real")

    return build


def log(*a: E) -> E:
    if len(a) == 1:
        return logarithm("log10")(a[0])
    if both_null(*a):
        return NULL
    x, b = (f"CAST({number(e).sql} AS DOUBLE)" for e in (a[1], a[0]))
    return E(f"CASE WHEN {x} = 0 OR {b} = 0 THEN NULL WHEN {x} < 0 OR {b} < 0 THEN raise_error('Complex number as result') ELSE log({b}, {x}) END", "real")


def power(a: E, b: E) -> E:
    return NULL if both_null(a, b) else E(f"pow(CAST({number(a).sql} AS DOUBLE), CAST({number(b).sql} AS DOUBLE))", "real")


def rounded(fn: str):
    def build(a: E) -> E:
        if a.type == "null":
            return NULL
        n = number(a)
        if n.type == "integer" and fn != "bround":
            return n
        return E(f"CAST({fn}(CAST({n.sql} AS DOUBLE)) AS DOUBLE)" if fn != "bround" else f"rint(CAST({n.sql} AS DOUBLE))", "real")

    return build


def extreme(fn: str):
    def build(*a: E) -> E:
        if any(x.type == "null" for x in a):
            return NULL
        t = a[0].type
        for x in a[1:]:
            t = unify(t, x.type)
        parts = [cast_to(x, t) for x in a]
        return E(f"CASE WHEN {' AND '.join(f'{p} IS NOT NULL' for p in parts)} THEN {fn}({', '.join(parts)}) END", t)

    return build


# -- comparison


def comparable(a: E, b: E) -> tuple[E, E] | None:
    """Both as something Spark compares; None if their types never equal."""
    if a.type == b.type or a.type in NUMERIC and b.type in NUMERIC or a.type in TEMPORAL and b.type in TEMPORAL:
        return a, b
    for x, y, flip in ((a, b, False), (b, a, True)):
        if x.type == "doc":
            if y.type in NUMERIC:
                x = E(scalar(x, "real"), "real")
            elif y.type in ("text", "boolean", "date", "timestamp", "time"):
                x = E(scalar(x, y.type), y.type)
            else:
                y = doc(y)
            return (y, x) if flip else (x, y)
    if isinstance(a.type, tuple) and isinstance(b.type, tuple):
        if {a.type[0], b.type[0]} == {"array"} and not (a.type[1] in NUMERIC and b.type[1] in NUMERIC) and ("null" in (a.type[1], b.type[1])):
            return doc(a), doc(b)
        if "array" not in (a.type[0], b.type[0]):
            return doc(a), doc(b)
    return None


_RANK = {"boolean": 0, "integer": 1, "real": 1, "date": 2, "timestamp": 2, "time": 2, "interval": 2, "text": 3, "blob": 4}


def compare(op: str, a: E, b: E) -> E:
    if both_null(a, b):
        return E("CAST(NULL AS BOOLEAN)", "boolean")
    pair = comparable(a, b)
    if pair is None:
        if op in ("=", "<>"):
            value = "false" if op == "=" else "true"
        else:
            p, q = (_RANK.get(x.type if isinstance(x.type, str) else "", 5) for x in (a, b))
            if p == q:
                return E("CAST(NULL AS BOOLEAN)", "boolean")
            value = "true" if (p < q) == (op in ("<", "<=")) else "false"
        return E(f"CASE WHEN {a.sql} IS NOT NULL AND {b.sql} IS NOT NULL THEN {value} END", "boolean")
    a, b = pair
    nested = isinstance(a.type, tuple) or isinstance(b.type, tuple)
    if nested and (op not in ("=", "<>") or "object" in str(a.type) or "map" in str(a.type)):
        return E(f"(pl_compare({to_doc(a)}, {to_doc(b)}) {op} 0)", "boolean")
    if a.type == "doc" and op not in ("=", "<>"):
        return E(f"(pl_compare({a.sql}, {b.sql}) {op} 0)", "boolean")
    return E(f"({a.sql} {op} {b.sql})", "boolean")


def identical(a: E, b: E, strict: bool) -> E:
    """IS (strict: no widening) and IS NOT DISTINCT FROM."""
    if b.type == "null" or a.type == "null":
        return E(" AND ".join(f"{x.sql} IS NULL" for x in (a, b) if x.type != "null") or "true", "boolean")
    if a.type == b.type or not strict and comparable(a, b):
        x, y = (a, b) if a.type == b.type and isinstance(a.type, str) else comparable(doc(a), doc(b)) if isinstance(a.type, tuple) else comparable(a, b)
        return E(f"({x.sql} <=> {y.sql})", "boolean")
    if "doc" in (a.type, b.type):
        return E(f"({to_doc(a)} <=> {to_doc(b)})", "boolean")
    return E(f"({a.sql} IS NULL AND {b.sql} IS NULL)", "boolean")


def boolean(e: E) -> str:
    """A condition: anything but exactly true is not true."""
    if e.type == "boolean":
        return e.sql
    if e.type == "doc":
        return f"({e.sql} = 'true')"
    return "CAST(NULL AS BOOLEAN)"


# -- text


def as_text(e: E) -> str:
    """CAST AS text: what ``||`` and functions see of other types."""
    t, s = e.type, e.sql
    if t == "text":
        return s
    if t == "null":
        return "CAST(NULL AS STRING)"
    if t == "blob":
        return f"decode({s}, 'UTF-8')"
    if t == "interval":
        return iso_interval(s)
    if t == "timestamp":
        return f"concat(date_format({s}, \"yyyy-MM-dd'T'HH:mm:ss\"), regexp_replace(date_format({s}, '.SSSSSS'), '\\\\.?0+$', ''), 'Z')"
    if t == "doc":
        return f"coalesce({scalar(e, 'text')}, {s})"
    if isinstance(t, tuple):
        return to_doc(e)
    return f"CAST({s} AS STRING)"


def concat(a: E, b: E) -> E:
    if both_null(a, b) and not any(isinstance(x.type, tuple) and x.type[0] == "array" for x in (a, b)):
        return NULL
    arrays = [isinstance(x.type, tuple) and x.type[0] == "array" for x in (a, b)]
    if any(arrays):
        items = [x.type[1] if y else x.type for x, y in zip((a, b), arrays, strict=True)]
        if items[0] == items[1] or "null" in items:
            t = items[0] if items[0] != "null" else items[1]
            part = [(f"CAST({x.sql} AS {ddl(('array', t))})" if x.type[1] == "null" else x.sql) if y else f"array({x.sql})" for x, y in zip((a, b), arrays, strict=True)]
            return E(f"concat({', '.join(part)})", ("array", t))
        return E(f"pl_concat({to_doc(a)}, {to_doc(b)})", "doc")
    if any(x.type == "doc" or isinstance(x.type, tuple) for x in (a, b)):
        if all(isinstance(x.type, tuple) and x.type[0] == "object" for x in (a, b)):
            return object_of([(k, E(f"{x.sql}.{quote(k)}", t)) for x in (a, b) for k, t in x.type[1]])
        return E(f"pl_concat({to_doc(a)}, {to_doc(b)})", "doc")
    if a.type == b.type == "blob":
        return E(f"concat({a.sql}, {b.sql})", "blob")
    return E(f"concat({as_text(a)}, {as_text(b)})", "text")


def length(a: E) -> E:
    if a.type == "null":
        return NULL
    if a.type == "doc":
        return E(f"CAST(pl_length({a.sql}) AS BIGINT)", "integer")
    if isinstance(a.type, tuple):
        return E(f"CAST(size({a.sql}) AS BIGINT)" if a.type[0] != "object" else f"CAST(pl_length({to_doc(a)}) AS BIGINT)", "integer")
    return E(f"CAST(length({a.sql if a.type in ('text', 'blob') else as_text(a)}) AS BIGINT)", "integer")


def text_fn(fn: str, result: str = "text"):
    def build(*a: E) -> E:
        if any(x.type == "null" for x in a):
            return NULL
        call = f"{fn}({', '.join(as_text(x) for x in a)})"
        return E(f"CAST({call} AS BIGINT)" if result == "integer" else call, result)

    return build


def trim(side: str):
    def build(a: E, chars: E | None = None) -> E:
        if a.type == "null" or chars and chars.type == "null":
            return NULL
        return E(f"trim({side} {as_text(chars) if chars else "' '"} FROM {as_text(a)})", "text")

    return build


def substring(a: E, start: E, n: E | None = None) -> E:
    if any(x is not None and x.type == "null" for x in (a, start, n)):
        return NULL
    s, nothing, kind = (a.sql, "x''", "blob") if a.type == "blob" else (as_text(a), "''", "text")
    at = f"CAST({start.sql} AS INT)"
    if n is None:
        return E(f"CASE WHEN {at} = 0 THEN {nothing} ELSE substring({s}, {at}) END", kind)
    k = f"CAST({n.sql} AS INT)"
    return E(f"CASE WHEN {k} < 0 THEN raise_error('Invalid end index') WHEN {at} = 0 THEN {nothing} ELSE substring({s}, {at}, {k}) END", kind)


def like(kind: str, value: E, pattern: E, escape: E | None = None) -> E:
    if both_null(value, pattern):
        return E("CAST(NULL AS BOOLEAN)", "boolean")
    s, p = as_text(value), as_text(pattern)
    if kind == "LIKE":
        if escape is not None:
            if escape.is_const and len(str(escape.const)) != 1:
                raise SqlError("Invalid escape character")
            return E(f"({s} LIKE {p} ESCAPE {text(escape.const)})", "boolean")
        if pattern.is_const:
            c = pattern.const
            cond = f"{s} LIKE {text(c.replace(chr(92), chr(92) * 2))}"
            if "%" in c:  # which does not cross line ends
                cond += f" AND (instr({s}, '\\n') = 0 OR {s} RLIKE {text(wildcards(c, '%', '_'))})"
            return E(f"({cond})", "boolean")
        return E(f"({s} LIKE replace({p}, '\\\\', '\\\\\\\\'))", "boolean")
    if kind == "GLOB":
        if pattern.is_const:
            return E(f"({s} RLIKE {text(wildcards(pattern.const, '*', '?'))})", "boolean")
        quoted = f"regexp_replace({p}, '([^*?A-Za-z0-9_ ])', '\\\\\\\\$1')"
        return E(f"({s} RLIKE concat('^', replace(replace({quoted}, '*', '.*'), '?', '.'), '$'))", "boolean")
    return E(f"({s} RLIKE {p})", "boolean")


def wildcards(pattern: str, many: str, one: str) -> str:
    """A pattern with two wild cards as a regular expression."""
    return "^" + "".join("[^\\n]*" if c == many else "[^\\n]" if c == one else re.escape(c) for c in pattern) + "\\z"


def hexed(a: E) -> E:
    if a.type == "null":
        return E("''", "text", "", True)
    return E(f"coalesce(hex({a.sql if a.type == 'blob' else f"encode({as_text(a)}, 'UTF-8')"}), '')", "text")


def unhexed(a: E, ignore: E | None = None) -> E:
    if a.type == "null":
        return NULL
    s = as_text(a) if ignore is None else f"translate({as_text(a)}, {as_text(ignore)}, '')"
    return E(f"CASE WHEN length({s}) % 2 = 0 AND {s} RLIKE '^[0-9A-Fa-f]*$' THEN unhex({s}) END", "blob")


def char(*a: E) -> E:
    parts = [f"CASE WHEN {x.sql} IS NULL THEN '' WHEN {x.sql} < 256 THEN chr({x.sql}) ELSE decode(unhex(lpad(hex({x.sql}), 8, '0')), 'UTF-32') END" if x.type == "integer" else "''" for x in a]
    return E(f"concat({', '.join(parts)})" if parts else "''", "text")


def typeof(a: E) -> E:
    if a.type == "doc":
        return E(f"CASE WHEN {a.sql} IS NULL THEN 'null' ELSE trim(BOTH '\"' FROM pl_typeof({a.sql})) END", "text")
    if a.type == "null":
        return E("'null'", "text")
    return E(f"CASE WHEN {a.sql} IS NULL THEN 'null' ELSE '{name_of(a.type)}' END", "text")


def base64(a: E) -> E:
    if a.type == "null":
        return NULL
    return E(f"base64({a.sql})", "text") if a.type == "blob" else E(f"unbase64({as_text(a)})", "blob")


def sha1(a: E) -> E:
    return NULL if a.type == "null" else E(f"sha1({a.sql if a.type == 'blob' else as_text(a)})", "text")


# -- conditionals


def coalesce(*a: E) -> E:
    t = "null"
    for x in a:
        t = unify(t, x.type)
    kept = [x for x in a if x.type != "null"]
    return E(f"coalesce({', '.join(cast_to(x, t) for x in kept)})", t) if kept else NULL


def choose(arms: list[tuple[str, E]], other: E) -> E:
    t = other.type
    for _, x in arms:
        t = unify(t, x.type)
    if t == "null":
        return NULL
    side = lambda x: null_of(t) if x.type == "null" else cast_to(x, t)
    return E("CASE " + " ".join(f"WHEN {c} THEN {side(x)}" for c, x in arms) + f" ELSE {side(other)} END", t)


def nullif(a: E, b: E) -> E:
    return a if both_null(a, b) else E(f"CASE WHEN {compare('=', a, b).sql} THEN NULL ELSE {a.sql} END", a.type)


# -- date and time


def to_date(a: E) -> E:
    if a.type == "null":
        return NULL
    return E(f"CAST({a.sql} AS DATE)" if a.type in TEMPORAL else f"CASE WHEN {as_text(a)} RLIKE '^\\\\d{{4}}-\\\\d\\\\d-\\\\d\\\\d$' THEN try_cast({as_text(a)} AS DATE) END", "date")


def to_timestamp(a: E) -> E:
    if a.type == "null":
        return NULL
    return E(f"CAST({a.sql} AS TIMESTAMP)" if a.type in TEMPORAL else f"try_cast({as_text(a)} AS TIMESTAMP)", "timestamp")


def to_time(a: E) -> E:
    if a.type == "null":
        return NULL
    if a.type == "time":
        return a
    s = f"date_format({a.sql}, 'HH:mm:ss.SSSSSS')" if a.type in TEMPORAL else as_text(a)
    return E(f"try_cast({s} AS TIME(6))", "time")


def to_interval(a: E) -> E:
    if a.type == "null":
        return NULL
    if a.type == "interval":
        return a
    if a.is_const:
        try:
            return literal(duration(a.const), "interval")
        except SqlError:
            return NULL
    s = as_text(a)
    g = lambda n: f"coalesce(try_cast(regexp_extract({s}, '{ISO}', {n}) AS BIGINT), 0L)"
    secs = f"coalesce(try_cast(regexp_extract({s}, '{ISO}', 7) AS DECIMAL(20,9)), 0)"
    nanos = f"CAST(({g(5)} * 3600 + {g(6)} * 60 + {secs}) * 1000000000 AS BIGINT)"
    return E(f"CASE WHEN {s} RLIKE '{ISO}' THEN named_struct('months', CAST({g(1)} * 12 + {g(2)} AS INT), 'days', CAST({g(3)} * 7 + {g(4)} AS INT), 'nanos', {nanos}) END", "interval")


ISO = "^P(?=[0-9T])(?:([0-9]+)Y)?(?:([0-9]+)M)?(?:([0-9]+)W)?(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9.]+)S)?)?$"
#: Directives as Spark's date patterns, as other directives, and as expressions of a timestamp.
_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "y": "yy", "B": "MMMM", "b": "MMM", "h": "MMM", "A": "EEEE", "a": "EEE", "p": "a", "I": "hh", "f": "SSSSSS"}
_COMBINED = {"F": "%Y-%m-%d", "T": "%H:%M:%S", "D": "%m/%d/%y", "R": "%H:%M", "r": "%I:%M:%S %p", "c": "%a %b %e %H:%M:%S %Y", "x": "%m/%d/%y", "X": "%H:%M:%S", "n": "\n", "t": "\t", "z": "+0000", "Z": "UTC"}
_COMPUTED = {
    "s": "CAST(unix_seconds({0}) AS STRING)", "w": "CAST(dayofweek({0}) - 1 AS STRING)", "u": "CAST((dayofweek({0}) + 5) % 7 + 1 AS STRING)",
    "U": "lpad((dayofyear({0}) + 7 - dayofweek({0})) div 7, 2, '0')", "W": "lpad((dayofyear({0}) + 6 - (dayofweek({0}) + 5) % 7) div 7, 2, '0')", "V": "lpad(weekofyear({0}), 2, '0')",
    "G": "CAST(extract(YEAROFWEEK FROM {0}) AS STRING)", "g": "lpad(extract(YEAROFWEEK FROM {0}) % 100, 2, '0')", "C": "lpad(year({0}) div 100, 2, '0')",
    "e": "lpad(day({0}), 2, ' ')", "k": "lpad(hour({0}), 2, ' ')", "l": "lpad((hour({0}) + 11) % 12 + 1, 2, ' ')",
}


def strftime(fmt: E, a: E) -> E:
    if both_null(fmt, a):
        return NULL
    if not fmt.is_const:
        raise SqlError("Invalid argument types: STRFTIME needs a constant format")
    when = to_timestamp(a).sql if a.type != "time" else f"CAST(concat('1970-01-01 ', CAST({a.sql} AS STRING)) AS TIMESTAMP)"
    parts = []
    for plain, c in re.findall(r"([^%]+|%$)|%(.)", re.sub("%(.)", lambda m: _COMBINED.get(m[1], m[0]), fmt.const, flags=re.DOTALL), re.DOTALL):
        if plain or c == "%":
            parts.append(text(plain or "%"))
        elif c in _COMPUTED:
            parts.append(_COMPUTED[c].format(when))
        elif c in _STRFTIME:
            parts.append(f"date_format({when}, '{_STRFTIME[c]}')")
        else:
            raise SqlError(f"Invalid format: %{c}")
    return E(f"concat({', '.join(parts)})" if parts else "''", "text")


def unixepoch(a: E) -> E:
    return NULL if a.type == "null" else E(f"(unix_micros({to_timestamp(a).sql}) / 1000000D)", "real")


def julianday(a: E) -> E:
    return NULL if a.type == "null" else E(f"(unix_micros({to_timestamp(a).sql}) / 86400000000D + 2440587.5D)", "real")


def extract(part: E, a: E) -> E:
    if a.type == "null":
        return NULL
    p = part.const.upper()
    if a.type == "interval":
        s = a.sql
        f = {"YEAR": f"{s}.months DIV 12", "MONTH": f"{s}.months % 12", "DAY": f"{s}.days", "HOUR": f"{s}.nanos DIV 3600000000000", "MINUTE": f"{s}.nanos DIV 60000000000 % 60", "SECOND": f"({s}.nanos % 60000000000) / 1000000000D"}
        return E(f"({f[p]})", "real" if p == "SECOND" else "integer")
    when = a.sql if a.type in (*TEMPORAL, "time") else to_timestamp(a).sql
    if p == "SECOND":
        return E(f"CAST(extract(SECOND FROM {when if a.type != 'date' else f'CAST({when} AS TIMESTAMP)'}) AS DOUBLE)", "real")
    if p in ("HOUR", "MINUTE") and a.type == "date":
        return E("0L", "integer")
    return E(f"CAST(extract({p} FROM {when}) AS BIGINT)", "integer")


def period(a: E, b: E) -> E:
    return object_of([("start", a), ("end", b)])


def bound(e: E, which: str) -> E:
    """A period's start or end: of an object, a pair, or a single date or timestamp."""
    t = e.type
    if t in TEMPORAL:
        return E(f"CAST({e.sql} AS TIMESTAMP)", "timestamp")
    if isinstance(t, tuple) and t[0] == "object":
        x = access(e, ("key", which))
    elif isinstance(t, tuple) and t[0] == "array":
        x = access(e, ("index", literal(0 if which == "start" else 1)))
    elif t == "doc":
        x = E(from_doc(access(e, ("key", which)).sql, "timestamp"), "timestamp")
    else:
        raise SqlError(f"Invalid argument types: period expected, got {name_of(t)}")
    return E(f"CAST({x.sql} AS TIMESTAMP)", "timestamp")


#: What each predicate compares: a bound of the one period, and a bound of the other.
PERIODS = {
    "CONTAINS": (("start", "<=", "start"), ("end", ">=", "end")),
    "OVERLAPS": (("start", "<", "end"), ("end", ">", "start")),
    "EQUALS": (("start", "=", "start"), ("end", "=", "end")),
    "PRECEDES": (("end", "<=", "start"),),
    "SUCCEEDS": (("start", ">=", "end"),),
    "IMMEDIATELY_PRECEDES": (("end", "=", "start"),),
    "IMMEDIATELY_SUCCEEDS": (("start", "=", "end"),),
}


def period_bounds(kind: str, a: E, b: E) -> list[tuple[str, str, str]]:
    """The comparisons of a predicate; a single instant as the other one ends after itself."""
    return [(bound(a, x).sql, ">" if op == ">=" and kind == "CONTAINS" and b.type in TEMPORAL else op, bound(b, y).sql) for x, op, y in PERIODS[kind]]


def period_test(kind: str):
    def build(a: E, b: E) -> E:
        if both_null(a, b):
            return E("CAST(NULL AS BOOLEAN)", "boolean")
        return E(f"({' AND '.join(map(' '.join, period_bounds(kind, a, b)))})", "boolean")

    return build


# -- vectors


def vector(e: E) -> str:
    if isinstance(e.type, tuple) and e.type[0] == "array" and e.type[1] in (*NUMERIC, "null"):
        return f"transform({e.sql}, x_ -> CAST(x_ AS DOUBLE))"
    if e.type == "doc":
        return from_doc(e.sql, ("array", "real"))
    raise SqlError(f"Invalid argument types: vector expected, got {name_of(e.type)}")


def _checked(a: str, b: str, value: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN size({a}) <> size({b}) THEN raise_error(concat('Vectors need same dimensions: ', size({a}), ' is not ', size({b}))) ELSE {value} END"


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x_, y_) -> x_ * y_), 0D, (s_, v_) -> s_ + v_)"


def l2_distance(a: E, b: E) -> E:
    if both_null(a, b):
        return NULL
    a, b = vector(a), vector(b)
    return E(_checked(a, b, f"sqrt(aggregate(zip_with({a}, {b}, (x_, y_) -> (x_ - y_) * (x_ - y_)), 0D, (s_, v_) -> s_ + v_))"), "real")


def inner_product(a: E, b: E, sign: str = "") -> E:
    if both_null(a, b):
        return NULL
    a, b = vector(a), vector(b)
    return E(_checked(a, b, f"{sign}{_dot(a, b)}"), "real")


def cosine_distance(a: E, b: E) -> E:
    if both_null(a, b):
        return NULL
    a, b = vector(a), vector(b)
    cos = f"try_divide({_dot(a, b)}, sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}))"
    return E(_checked(a, b, f"CASE WHEN {cos} IS NOT NULL THEN 1D - least(1D, greatest(-1D, {cos})) END"), "real")


# -- cast

_CASTS = {"VARCHAR": "text", "CHAR": "text", "TEXT": "text", "STRING": "text", "BLOB": "blob", "VARBINARY": "blob", "INTEGER": "integer", "INT": "integer", "SMALLINT": "integer", "BIGINT": "integer", "SIGNED": "integer", "DECIMAL": "number", "NUMERIC": "number", "REAL": "real", "DOUBLE": "real", "FLOAT": "real", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "DATETIME": "timestamp", "DATE": "date", "TIME": "time", "INTERVAL": "interval"}


def cast(e: E, kind: str, size=None) -> E:
    to = _CASTS.get(kind)
    if to is None:
        raise SqlError(f"Unknown type: {kind}")
    if e.type == "null":
        return NULL
    s = e.sql
    if to == "text":
        out = as_text(e)
        if kind == "CHAR" and size:
            out = f"rpad({out}, {int(size)}, ' ')"
        elif kind == "VARCHAR" and size:
            out = f"substring({out}, 1, {int(size)})"
        return E(out, "text")
    if to == "blob":
        return e if e.type == "blob" else E(f"encode({as_text(e)}, 'UTF-8')", "blob")
    if to in ("integer", "number", "real"):
        if e.type == "boolean":
            e = E(f"CASE {s} WHEN true THEN 1L WHEN false THEN 0L END", "integer")
        elif e.type in ("text", "blob"):
            x = as_text(e)
            if to == "integer":
                return E(f"CASE WHEN {x} IS NOT NULL THEN coalesce(try_cast(regexp_extract({x}, '^\\\\s*([-+]?[0-9]+)', 1) AS BIGINT), 0L) END", "integer")
            return E(f"CASE WHEN {x} IS NOT NULL THEN coalesce(try_cast(regexp_extract({x}, '^\\\\s*([-+]?[0-9]+(?:\\\\.[0-9]*)?(?:[eE][-+]?[0-9]+)?)', 1) AS DOUBLE), 0D) END", "real")
        elif e.type == "doc":
            e = E(scalar(e, "real"), "real")
        elif e.type not in NUMERIC:
            raise SqlError(f"Invalid argument types: CAST({name_of(e.type)} AS {kind})")
        if to == "integer":
            return E(e.sql if e.type == "integer" else f"try_cast(rint({e.sql}) AS BIGINT)", "integer")
        return e if to == "number" else E(f"CAST({e.sql} AS DOUBLE)", "real")
    if to == "boolean":
        if e.type in NUMERIC:
            return E(f"({s} <> 0)", "boolean")
        return e if e.type == "boolean" else E(f"CASE lower({as_text(e)}) WHEN 'true' THEN true WHEN '1' THEN true WHEN 'false' THEN false WHEN '0' THEN false END", "boolean")
    return {"timestamp": to_timestamp, "date": to_date, "time": to_time, "interval": to_interval}[to](e)


# -- documents as functions


def doc_call(name: str, *args: E, result="doc") -> E:
    return E(f"{name}({', '.join(f"coalesce({to_doc(a)}, 'null')" if i and name not in ("pl_access", "pl_match", "pl_concat") else to_doc(a) for i, a in enumerate(args))})", result)


def keys(a: E) -> E:
    if a.type == "null":
        return NULL
    if isinstance(a.type, tuple) and a.type[0] == "map":
        return E(f"map_keys({a.sql})", ("array", "text"))
    if isinstance(a.type, tuple) and a.type[0] == "object":
        parts = ", ".join(f"CASE WHEN {a.sql}.{quote(k)} IS NOT NULL THEN {text(k)} END" for k, _ in sorted(a.type[1]))
        return E(f"CASE WHEN {a.sql} IS NOT NULL THEN filter(array({parts}), x_ -> x_ IS NOT NULL) END", ("array", "text"))
    return doc_call("pl_keys", a)


def path_call(name: str):
    def build(a: E, path: E, *new: E) -> E:
        args = [to_doc(a), path.sql if path.type == "doc" else to_doc(path), *(f"coalesce({to_doc(n)}, 'null')" for n in new)]
        return E(f"{name}({', '.join(args)})", "doc")

    return build


def nothing(sql: str, t):
    return lambda: E(sql, t)


#: name -> (least arguments, most, builder)
FUNCTIONS = {
    "ABS": (1, 1, lambda a: NULL if a.type == "null" else E(f"abs({number(a).sql})", number(a).type)),
    "SIGN": (1, 1, lambda a: NULL if a.type == "null" else E(f"CAST(sign({number(a).sql}) AS BIGINT)", "integer")),
    "ROUND": (1, 1, rounded("bround")), "FLOOR": (1, 1, rounded("floor")), "CEIL": (1, 1, rounded("ceil")), "CEILING": (1, 1, rounded("ceil")),
    "SQRT": (1, 1, math("sqrt", domain="{0} >= 0")), "EXP": (1, 1, math("exp")), "POWER": (2, 2, power), "POW": (2, 2, power),
    "MOD": (2, 2, lambda a, b: arithmetic("%", a, b)), "LOG": (1, 2, log), "LOG10": (1, 1, logarithm("log10")), "LOG2": (1, 1, logarithm("log2")), "LN": (1, 1, logarithm("ln")),
    **{n.upper(): (1, 1, math(n)) for n in ("sin", "cos", "tan", "atan", "sinh", "cosh", "tanh", "asinh", "degrees", "radians")},
    "ASIN": (1, 1, math("asin", domain="abs({0}) <= 1")), "ACOS": (1, 1, math("acos", domain="abs({0}) <= 1")), "ACOSH": (1, 1, math("acosh", domain="{0} >= 1")), "ATANH": (1, 1, math("atanh", domain="abs({0}) < 1")),
    "ATAN2": (2, 2, lambda a, b: NULL if both_null(a, b) else E(f"atan2(CAST({number(a).sql} AS DOUBLE), CAST({number(b).sql} AS DOUBLE))", "real")),
    "PI": (0, 0, nothing("pi()", "real")), "RANDOM": (0, 0, nothing("CAST((rand() * 2 - 1) * 9223372036854775807D AS BIGINT)", "integer")),
    "RANDOMBLOB": (1, 1, lambda a: E(f"unhex(left(concat_ws('', transform(sequence(1L, greatest(1L, {a.sql} DIV 16 + 1)), i_ -> replace(uuid(), '-', ''))), CAST(2 * {a.sql} AS INT)))", "blob")),
    "ZEROBLOB": (1, 1, lambda a: NULL if a.type == "null" else E(f"unhex(repeat('00', CAST({a.sql} AS INT)))", "blob")),
    "L2_DISTANCE": (2, 2, l2_distance), "INNER_PRODUCT": (2, 2, inner_product), "COSINE_DISTANCE": (2, 2, cosine_distance),
    "CONCAT": (2, 2, concat), "CHARACTER_LENGTH": (1, 1, text_fn("char_length", "integer")), "CHAR_LENGTH": (1, 1, text_fn("char_length", "integer")),
    "OCTET_LENGTH": (1, 1, lambda a: NULL if a.type == "null" else E(f"CAST(octet_length({a.sql if a.type == 'blob' else as_text(a)}) AS BIGINT)", "integer")),
    "LENGTH": (1, 1, length), "CARDINALITY": (1, 1, length), "TRIM": (1, 2, trim("BOTH")), "LTRIM": (1, 2, trim("LEADING")), "RTRIM": (1, 2, trim("TRAILING")),
    "LOWER": (1, 1, text_fn("lower")), "UPPER": (1, 1, text_fn("upper")), "REPLACE": (3, 3, text_fn("replace")), "SUBSTRING": (2, 3, substring), "SUBSTR": (2, 3, substring),
    "INSTR": (2, 2, text_fn("instr", "integer")), "POSITION": (2, 2, lambda a, b: text_fn("instr", "integer")(b, a)), "CHAR": (0, 99, char),
    "UNICODE": (1, 1, lambda a: NULL if a.type == "null" else E(f"CASE WHEN {as_text(a)} <> '' THEN CAST(ascii({as_text(a)}) AS BIGINT) END", "integer")),
    "HEX": (1, 1, hexed), "UNHEX": (1, 2, unhexed), "BASE64": (1, 1, base64), "SHA1": (1, 1, sha1), "UUID": (0, 0, nothing("uuid()", "text")),
    "UUID_BLOB": (1, 1, lambda a: NULL if a.type == "null" else a if a.type == "blob" else E(f"unhex(replace({as_text(a)}, '-', ''))", "blob")),
    "UUID_STR": (1, 1, lambda a: NULL if a.type == "null" else E(f"lower(regexp_replace({f'hex({a.sql})' if a.type == 'blob' else f"replace({as_text(a)}, '-', '')"}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5'))", "text")),
    "TYPEOF": (1, 1, typeof), "COALESCE": (1, 99, coalesce), "IFNULL": (2, 2, coalesce), "NULLIF": (2, 2, nullif), "IIF": (3, 3, lambda c, a, b: choose([(boolean(c), a)], b)),
    "DATE": (1, 1, to_date), "TIME": (1, 1, to_time), "DATETIME": (1, 1, to_timestamp), "TIMESTAMP": (1, 1, to_timestamp), "DURATION": (1, 1, to_interval), "STRFTIME": (2, 2, strftime),
    "UNIXEPOCH": (1, 1, unixepoch), "JULIANDAY": (1, 1, julianday), "EXTRACT": (2, 2, extract), "PERIOD": (2, 2, period),
    **{k: (2, 2, period_test(k)) for k in PERIODS},
    "MATCH": (2, 2, lambda a, b: E("CAST(NULL AS BOOLEAN)", "boolean") if both_null(a, b) else doc_call("pl_match", a, b, result="boolean")),
    "PATCH": (2, 2, lambda a, b: doc_call("pl_patch", a, b)), "OBJECT_KEYS": (1, 1, keys), "OBJECT_VALUES": (1, 1, lambda a: doc_call("pl_values", a)),
    "OBJECT_ENTRIES": (1, 1, lambda a: doc_call("pl_entries", a)), "OBJECT_FROM_ENTRIES": (1, 1, lambda a: doc_call("pl_from_entries", a)),
    "PATH_SET": (3, 3, path_call("pl_set")), "PATH_INSERT": (3, 3, path_call("pl_insert")), "PATH_REPLACE": (3, 3, path_call("pl_replace")), "PATH_REMOVE": (2, 2, path_call("pl_remove")), "PATH_EXTRACT": (2, 2, path_call("pl_extract")),
    "LIKE": (2, 3, lambda p, s, e=None: like("LIKE", s, p, e)), "GLOB": (2, 2, lambda p, s: like("GLOB", s, p)), "REGEXP": (2, 2, lambda p, s: like("REGEXP", s, p)),
    "BETWEEN": (3, 3, lambda x, a, b: E(f"({compare('>=', x, a).sql} AND {compare('<=', x, b).sql})", "boolean")), "ARRAY": (0, 99, lambda *a: array_of(list(a))),
    "MIN": (2, 99, extreme("least")), "MAX": (2, 99, extreme("greatest")),
}
