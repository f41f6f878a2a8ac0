"""Statements that change versioned tables: insert, upsert, update, delete, erase."""

from __future__ import annotations

import json

from palimpsest.dialect.lexer import SqlError
from palimpsest.dialect.parser import Select, Source
from palimpsest.functions import scalar as fx
from palimpsest.plans.lower import Lowered, Lowering, Rel, Scope
from palimpsest.plans.types import E, quote, text


def with_ctes(d: dict, low: Lowering) -> dict:
    from palimpsest.dialect.parser import Query

    ctes: dict = {}
    if d["ctes"]:
        low.with_clause(Query(None, d["ctes"], d["recursive"]), None, ctes)
    return ctes


def incoming(session, d: dict, low: Lowering) -> Lowered:
    """The new rows and their columns."""
    q = d["query"]
    out = low.query(q, None, with_ctes(d, low))
    names = d["columns"]
    if names:
        if len(names) != len(out.columns):
            raise SqlError("Number of column names does not match projection")
        out = Lowered(f"SELECT * FROM ({out.sql}) AS n_({', '.join(map(quote, names))})", [(n, t) for n, (_, t) in zip(names, out.columns, strict=True)])
    elif isinstance(q.body, tuple) and q.body[0] == "values":
        meta = session.manifest["tables"].get(d["table"])
        if not (meta and meta["created"]):
            raise SqlError("Column names are required for values")
        names = sorted(meta["columns"], key=lambda n: (meta["columns"][n], n))
        if len(names) != len(out.columns):
            raise SqlError("Number of column names does not match projection")
        out = Lowered(f"SELECT * FROM ({out.sql}) AS n_({', '.join(map(quote, names))})", [(n, t) for n, (_, t) in zip(names, out.columns, strict=True)])
    session.check_names(d["table"], [n for n, _ in out.columns])
    return out


def insert(session, d: dict, low: Lowering) -> int:
    new = incoming(session, d, low)
    if d["conflict"]:
        if session.sqlite_mode:
            raise SqlError("ON CONFLICT is not supported in SQLite mode")
        return upsert(session, d, low, new)
    return session.store.append(session.manifest, d["table"], session.frame(new), new.columns, session.now())


def scan(session, d: dict, low: Lowering, period=None) -> tuple[str, Rel, list]:
    """(SQL, source, columns) of the table that a statement changes."""
    found = session.table(d["table"], period, low)
    if found is None or d["table"] not in session.manifest["tables"]:
        raise SqlError(f"Unknown table: {d['table']}")
    sql, columns, hidden = found
    a = low.alias()
    rel = Rel(d.get("alias") or d["table"], [(n, E(f"{a}.{quote(n)}", t)) for n, t in columns], {n: E(x.sql.format(a=a), x.type) for n, x in hidden.items()})
    return f"{sql} AS {a}", rel, columns


def remove(session, d: dict, low: Lowering, kind: str) -> int:
    """Delete (the rows end now) or erase (they vanish from all times)."""
    ctes = with_ctes(d, low)
    sql, rel, _ = scan(session, d, low, ("all",) if kind == "erased" else None)
    where = low.condition(d["where"], Scope([rel]), ctes) if d["where"] is not None else "true"
    rows = session.spark.sql(f"SELECT {rel.hidden['_batch'].sql} AS _batch, {rel.hidden['_row'].sql} AS _row FROM {sql} WHERE {where}")
    return session.store.log(session.manifest, d["table"], rows, kind, session.now())


def changed(d: dict, low: Lowering, scope: Scope, ctes: dict, rel: Rel) -> list[tuple[str, E]]:
    """The columns of a row after SET, UNSET and PATCH, in this order."""
    if not d["set"] and not d["unset"] and d["patch"] is None:
        raise SqlError("Update requires at least one set or unset column or patch")
    row = dict(rel.columns)
    for path, e in d["set"]:
        value = low.expr(e, scope, ctes)
        if len(path) == 1:
            row[path[0]] = value
        else:
            old = row.get(path[0], fx.NULL)
            row[path[0]] = E(f"pl_set({fx.to_doc(old)}, {text(json.dumps(path[1:]))}, coalesce({fx.to_doc(value)}, 'null'))", "doc")
    for path in d["unset"]:
        if len(path) == 1:
            row.pop(path[0], None)
        elif path[0] in row:
            row[path[0]] = E(f"pl_remove({fx.to_doc(row[path[0]])}, {text(json.dumps(path[1:]))})", "doc")
    if d["patch"] is not None:
        p = low.expr(d["patch"], scope, ctes)
        if p.is_const is False and isinstance(p.type, tuple) and p.type[0] == "object":
            literal = {x[1]: x[2] for x in d["patch"][1] if x[0] == "kv"} if d["patch"][0] == "object" else {}
            for k, t in p.type[1]:
                if k in literal and literal[k][:2] == ("lit", None):
                    row.pop(k, None)
                    continue
                value = E(f"{p.sql}.{quote(k)}", t)
                if isinstance(t, tuple) and t[0] == "object" and k in row:
                    value = E(f"pl_patch({fx.to_doc(row[k])}, {fx.to_doc(value)})", "doc")
                row[k] = value
        else:
            raise SqlError("Invalid argument types: PATCH needs an object with literal keys")
    return [(k, v) for k, v in row.items()]


def update(session, d: dict, low: Lowering) -> int:
    ctes = with_ctes(d, low)
    sql, rel, _ = scan(session, d, low)
    scope = Scope([rel])
    row = changed(d, low, scope, ctes, rel)
    session.check_names(d["table"], [n for n, _ in row]) if not session.manifest["tables"][d["table"]]["created"] else None
    where = low.condition(d["where"], scope, ctes) if d["where"] is not None else "true"
    return rewrite(session, d["table"], row, rel, f"{sql} WHERE {where}")


def rewrite(session, table: str, row: list[tuple[str, E]], rel: Rel, source: str) -> int:
    """End the matched rows and append them as changed."""
    cells = ", ".join(f"{fx.null_of(e.type) if e.type == 'null' else e.sql} AS {quote(n)}" for n, e in row)
    ids = f"{rel.hidden['_batch'].sql} AS _batch, {rel.hidden['_row'].sql} AS _row"
    old = session.spark.sql(f"SELECT {ids} FROM {source}")
    new = session.spark.sql(f"SELECT {cells} FROM {source}")
    added = session.store.append(session.manifest, table, new, [(n, e.type) for n, e in row], session.now())
    if added:
        session.store.log(session.manifest, table, old, "ended", session.now())
    return added


def upsert(session, d: dict, low: Lowering, new: Lowered) -> int:
    """Insert, or change the current rows that agree on the conflict columns (null agrees with null)."""
    c = d["conflict"]
    keys = c["keys"]
    names = [n for n, _ in new.columns]
    for k in keys:
        if k not in names:
            raise SqlError(f"Unknown column: {k}")
    if not c["nothing"]:
        touched = {p[0] for p, _ in c["set"]} | {p[0] for p in c["unset"]}
        if touched & set(keys):
            raise SqlError("Cannot update the on conflict columns")
    from palimpsest.operators.recursion import checkpointed

    fresh = checkpointed(session.frame(new))  # read three times, and must not change between
    if not fresh.groupBy(*keys).count().where("count > 1").isEmpty():
        raise SqlError("Inserted values cannot contain duplicated on conflict columns")
    view = session.view(fresh)
    if d["table"] not in session.manifest["tables"]:
        return session.store.append(session.manifest, d["table"], fresh, new.columns, session.now())
    sql, rel, _ = scan(session, d, low)
    b = low.alias()
    excluded = Rel("excluded", [(n, E(f"{b}.{quote(n)}", t)) for n, t in new.columns])
    own, theirs = dict(rel.columns), dict(excluded.columns)
    same = " AND ".join(fx.identical(own.get(k, fx.NULL), theirs[k], strict=False).sql for k in keys)
    missing = session.spark.sql(f"SELECT {b}.* FROM {view} AS {b} LEFT ANTI JOIN {sql} ON {same}")
    missing = checkpointed(missing)
    count = 0
    if not c["nothing"]:
        scope = Scope([rel, excluded])
        inner = Lowering(session, low.params)
        inner.numbers, inner.used = low.numbers, low.used
        row = changed(c, inner, Scope([rel, excluded]), {}, rel)
        where = inner.condition(c["where"], scope, {}) if c["where"] is not None else "true"
        count += rewrite(session, d["table"], row, rel, f"{sql} INNER JOIN {view} AS {b} ON {same} WHERE {where}")
    return count + session.store.append(session.manifest, d["table"], missing, new.columns, session.now())


__all__ = ["insert", "update", "remove", "Select", "Source"]
