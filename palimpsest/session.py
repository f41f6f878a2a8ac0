"""The engine's entry: statements in, DataFrames or counts out."""

from __future__ import annotations

import copy
import datetime as dt
import re
import time
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.dialect.lexer import SqlError
from palimpsest.dialect.parser import Parser, Statement, parse
from palimpsest.functions import documents
from palimpsest.functions import scalar as fx
from palimpsest.operators import dml
from palimpsest.operators.recursion import fixpoint
from palimpsest.plans.lower import Lowered, Lowering, Scope, unique
from palimpsest.plans.types import E, of_spark, quote
from palimpsest.sources import parameters, results
from palimpsest.sources.versioned import Conflict, Store, empty

#: What the dialect needs; set for the time of a statement and put back.
CONF = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.groupByOrdinal": "false",
    "spark.sql.orderByOrdinal": "true",
    "spark.sql.legacy.setopsPrecedence.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.crossJoin.enabled": "true",
}
SAVEPOINT_SECONDS = 60
_NAMES = count()
_IDENTIFIER = re.compile(r"[^\W\d]\w*")


def value(x: Any, t: Any) -> Any:
    """A cell of a result as the Python value of its type."""
    if x is None or isinstance(t, str):
        return documents.python(documents.load(x)) if t == "doc" else x
    if t[0] == "array":
        return [value(y, t[1]) for y in x]
    return {k: value(y, t[1]) for k, y in x.items()} if t[0] == "map" else {k: value(x[k], y) for k, y in t[1]}


class Session:
    """Statements over external tables (read only) and versioned tables under ``path`` (if given)."""

    def __init__(self, spark: SparkSession, path: str | None = None, sqlite_mode: bool = False):
        self.spark, self.sqlite_mode = spark, sqlite_mode
        self.store = Store(spark, path) if path else None
        self.external: dict[str, tuple[DataFrame | str, list | tuple]] = {}
        self.work: dict | None = None  # the open transaction's manifest
        self.began = 0
        self.savepoints: dict[str, tuple[float, dict]] = {}
        self.clock: dt.datetime | None = None
        self.last: dt.datetime | None = None
        self.views: list[str] = []
        self.answers: list[Any] = []  # of each statement of the last call
        self.manifest: dict = {"tables": {}, "views": {}, "assertions": {}}
        documents.register(spark)

    # -- tables

    def register(self, name: str, table: DataFrame | str, documents: tuple[str, ...] = ()) -> None:
        """An external table: a DataFrame, or the path of a Parquet table; ``documents`` are text columns that hold JSON."""
        self.external[name] = (table, documents)

    def outside(self, name: str) -> tuple[DataFrame, list]:
        """An external table's rows and columns; a path is opened when a statement first names its table."""
        table, found = self.external[name]
        if isinstance(found, tuple):
            df = self.spark.read.parquet(table) if isinstance(table, str) else table
            self.external[name] = (df, [(f.name, "doc" if f.name in found else of_spark(f.dataType)) for f in df.schema])
        return self.external[name]

    def now(self) -> dt.datetime:
        return self.clock

    def view(self, df: DataFrame) -> str:
        name = f"pl_{next(_NAMES)}_"
        df.createOrReplaceTempView(name)
        self.views.append(name)
        return name

    def table(self, name: str, period: tuple | None, lowering: Lowering):
        """(SQL, columns, hidden columns) of a table or view; None if there is none."""
        if name.startswith("information_schema."):
            return self.information(name.partition(".")[2])
        if name in self.manifest["views"] and not period:
            v = self.manifest["views"][name]
            low = Lowering(self).query(Parser(v["sql"]).query())
            names = v["columns"] or [n for n, _ in low.columns]
            cols = [(n, t) for n, (_, t) in zip(names, low.columns, strict=True)]
            return f"(SELECT * FROM ({low.sql}) AS v_({', '.join(map(quote, unique(cols)))}))", cols, {}
        if meta := self.manifest["tables"].get(name):
            columns = self.store.columns_of(meta)
            df = self.store.scan(meta, period)
            df = empty(self.spark, columns) if df is None else df
            columns = [(n, "text" if t == "null" else t) for n, t in columns]
            doc = fx.object_of([(n, E(f"{{a}}.{quote(n)}", t)) for n, t in columns])
            stamp = E("named_struct('start', {a}._start, 'end', {a}._end)", ("object", (("start", "timestamp"), ("end", "timestamp"))))
            hidden = {} if self.sqlite_mode else {"!doc": doc, "system_time": stamp}
            hidden |= {n: E(f"{{a}}.{n}", t) for n, t in (("_batch", "text"), ("_row", "integer"))}
            return self.view(df), columns, hidden
        if name in self.external:
            df, columns = self.outside(name)
            doc = fx.object_of([(n, E(f"{{a}}.{quote(n)}", t)) for n, t in columns])
            return self.view(df), columns, {"!doc": doc}
        return None

    def information(self, name: str):
        text = "text"
        m = self.manifest
        if name == "tables":
            cols = [("table_catalog", text), ("table_schema", text), ("table_name", text), ("table_type", text)]
            rows = [(None, "main", n, "BASE TABLE") for n in sorted({*m["tables"], *self.external})] + [(None, "main", n, "VIEW") for n in sorted(m["views"])]
        elif name == "columns":
            cols = [("table_catalog", text), ("table_schema", text), ("table_name", text), ("column_name", text), ("ordinal_position", "integer")]
            rows = [(None, "main", t, c, p) for t, meta in sorted(m["tables"].items()) for c, p in sorted(meta["columns"].items(), key=lambda x: (x[1], x[0]))]
            rows += [(None, "main", t, c, i + 1) for t in sorted(self.external) for i, (c, _) in enumerate(self.outside(t)[1])]
        elif name == "views":
            cols = [("table_catalog", text), ("table_schema", text), ("table_name", text), ("view_definition", text)]
            rows = [(None, "main", n, v["sql"]) for n, v in sorted(m["views"].items())]
        elif name == "check_constraints":
            cols = [("constraint_catalog", text), ("constraint_schema", text), ("constraint_name", text), ("check_clause", text)]
            rows = [(None, "main", n, s) for n, s in sorted(m["assertions"].items())]
        else:
            return None
        schema = ", ".join(f"{n} {'long' if t == 'integer' else 'string'}" for n, t in cols)
        return self.view(self.spark.createDataFrame(rows, schema)), cols, {}

    # -- running

    @contextmanager
    def configured(self):
        conf = self.spark.conf
        old = {k: conf.get(k, None) for k in CONF}
        for k, v in CONF.items():
            conf.set(k, v)
        try:
            yield
        finally:
            for k, v in old.items():
                conf.unset(k) if v is None else conf.set(k, v)
            for v in self.views:
                self.spark.catalog.dropTempView(v)
            self.views.clear()

    def execute(self, sql: str, params: Any = None, many: bool = False) -> Any:
        """Run statements in order; the last one's result: a DataFrame for queries, a count or True for others.

        With ``many`` the statement runs once for each set of parameters, in one transaction.
        """
        statements = parse(sql)
        if not statements:
            raise SqlError("No statement")
        if len(statements) > 1 and any(s.kind in ("begin", "commit", "rollback", "savepoint", "release", "rollback_to") for s in statements):
            raise SqlError("Explicit transactions not supported in multiple statements")
        sets = parameters.batches(params) if many else [parameters.numbered(params)]
        with self.configured():
            return self.attempt(statements, sets)

    def attempt(self, statements: list[Statement], sets: list[dict], tries: int = 5) -> Any:
        """Run on the newest snapshot; publish what changed, or run again if another writer came first."""
        for left in reversed(range(tries)):
            inside = self.work is not None
            self.manifest = self.work if inside else copy.deepcopy(self.store.latest()) if self.store else self.manifest
            before = copy.deepcopy(self.manifest)
            if not inside:
                self.tick()
            try:
                result, self.answers = None, []
                for s in statements:
                    for p in sets:
                        result = self.one(s, p)
                    self.answers.append(result)
            except Exception:
                if inside and self.work is not None:
                    self.work = before
                raise
            if self.work is not None or inside or self.manifest == before or not self.store:
                return result
            self.check_assertions()
            try:
                self.store.publish(self.manifest, self.clock)
                return result
            except Conflict:
                if not left:
                    raise
        return None

    def tick(self) -> None:
        """A transaction's time: later than any before in this session."""
        now = dt.datetime.now(dt.timezone.utc)
        now = max(now, self.last + dt.timedelta(microseconds=1)) if self.last else now
        self.clock = self.last = now

    def one(self, s: Statement, params: dict) -> Any:
        run = getattr(self, "do_" + s.kind)
        low = Lowering(self, params)
        try:
            result = run(s.data, low)
        except AnalysisException as err:
            raise SqlError(analysis(err)) from err
        if params and set(params) != low.used:
            raise SqlError(f"Required parameters: {sorted(map(str, low.used))} does not match given: {sorted(map(str, params))}")
        return result

    def frame(self, low: Lowered) -> DataFrame:
        df = self.spark.sql(low.sql)
        return df.toDF(*(n for n, _ in low.columns)) if df.columns != [n for n, _ in low.columns] else df

    def recursive(self, base: Lowered, step, every: bool, query) -> Lowered:
        """Run a recursive query by rounds; its rows as a view."""
        from palimpsest.plans.types import unify

        first = self.frame(base)
        held = [base.columns]
        probe = step(self.view(first), base.columns)
        types = [unify(x, y) for (_, x), (_, y) in zip(base.columns, probe.columns, strict=True)]
        held = [(n, t) for (n, _), t in zip(base.columns, types, strict=True)]
        low = Lowering(self)

        def onward(rows: DataFrame) -> DataFrame:
            return self.frame(low.as_types(step(self.view(rows), held), types))

        found = fixpoint(self.spark, self.frame(low.as_types(base, types)), onward, every)
        out = Lowered(f"SELECT * FROM {self.view(found)}", held)
        if query.limit is not None:
            out = Lowered(out.sql + low.limits(query), held)
        return out

    def do_query(self, d: dict, low: Lowering) -> DataFrame:
        found = low.query(d["query"])
        df = self.frame(found)
        df.dialect_types = [t for _, t in found.columns]
        return df

    def rows(self, sql: str, params: Any = None, many: bool = False) -> Iterator[tuple]:
        """The last statement's rows as Python values, one partition at a time: documents and mixed columns too, each value by its own type."""
        result = self.execute(sql, params, many)
        if not isinstance(result, DataFrame):
            yield (result,)
            return
        types = self.rendered(result, "")[1]
        with self.configured():
            for row in result.toLocalIterator():
                yield tuple(value(x, t) for x, t in zip(row, types, strict=True))

    def rendered(self, result: Any, kind: str) -> tuple[DataFrame, list]:
        """A result's rows and types; a count or True as one row ``result``."""
        if not isinstance(result, DataFrame):
            return self.spark.createDataFrame([(result,)], "result boolean" if result is True else "result long"), ["boolean" if result is True else "integer"]
        return result, getattr(result, "dialect_types", None) or [of_spark(f.dataType) for f in result.schema]

    def stream(self, result: Any, kind: str = results.JSON) -> Iterator[bytes]:
        """What ``execute`` returned, in a media type of ``results.KINDS``, piece by piece."""
        with self.configured():
            yield from results.chunks(*self.rendered(result, kind), kind)

    def write(self, result: DataFrame, path: str, kind: str = results.ND) -> None:
        """Rows as text files in a folder, written by the executors."""
        with self.configured():
            results.lines(*self.rendered(result, kind), kind).write.text(path)

    # -- data

    def writable(self) -> None:
        if self.store is None:
            raise SqlError("This session has no path for versioned tables")

    def do_insert(self, d, low):
        self.writable()
        return dml.insert(self, d, low)

    def do_update(self, d, low):
        self.writable()
        return dml.update(self, d, low)

    def do_delete(self, d, low):
        self.writable()
        return dml.remove(self, d, low, "ended")

    def do_erase(self, d, low):
        self.writable()
        return dml.remove(self, d, low, "erased")

    def vacuum(self, keep: dt.timedelta = dt.timedelta(days=7)) -> int:
        """Delete manifests older than ``keep``, and files that only they name; the number of deletions. Readers of older snapshots fail."""
        self.writable()
        return self.store.vacuum(dt.datetime.now(dt.timezone.utc) - keep)

    def compact(self, table: str) -> None:
        """Rewrite a table's batches as one; rows that were erased are gone from the new files."""
        self.writable()
        self.tick()
        with self.configured():
            self.store.publish(self.store.compact(self.store.latest(), table), self.clock)

    # -- definitions

    def do_create_table(self, d, low):
        self.writable()
        if not self.sqlite_mode:
            raise SqlError("CREATE TABLE is only for SQLite mode; tables come with their first row")
        if d["name"] in self.manifest["tables"]:
            raise SqlError(f"Table already exists: {d['name']}")
        self.manifest["tables"][d["name"]] = {"batches": [], "ended": [], "erased": [], "columns": {c: i + 1 for i, c in enumerate(d["columns"])}, "created": True}
        return True

    def do_create_index(self, d, low):
        return True

    def do_drop_index(self, d, low):
        return True

    def drop(self, kind: str, d) -> bool:
        if d["name"] not in self.manifest[kind]:
            if d["if_exists"]:
                return True
            raise SqlError(f"No such {kind[:-1]}: {d['name']}")
        del self.manifest[kind][d["name"]]
        return True

    def do_drop_table(self, d, low):
        return self.drop("tables", d)

    def do_drop_view(self, d, low):
        return self.drop("views", d)

    def do_drop_assertion(self, d, low):
        return self.drop("assertions", d)

    def do_create_view(self, d, low):
        out = low.query(d["query"])
        if low.used or "param" in repr(d["query"]) and _has_param(d["query"]):
            raise SqlError("Views do not support parameters")
        if d["columns"] and len(d["columns"]) != len(out.columns):
            raise SqlError("Number of column names does not match projection")
        self.manifest["views"][d["name"]] = {"sql": d["sql"], "columns": d["columns"]}
        return True

    def do_create_assertion(self, d, low):
        if _has_param(d["expr"]):
            raise SqlError("Assertions do not support parameters")
        self.manifest["assertions"][d["name"]] = d["sql"]
        return True

    def check_assertions(self) -> None:
        """Only a result of false fails; a check that cannot be evaluated (say, for want of its table) is passed over."""
        for name, sql in self.manifest["assertions"].items():
            try:
                low = Lowering(self)
                e = low.expr(Parser(sql).expr(), Scope([]), {})
                value = self.spark.sql(f"SELECT {fx.boolean(e)} AS ok").first()[0]
            except (SqlError, AnalysisException):
                continue
            if value is False:
                raise SqlError(f"Constraint failed: {name}")

    # -- transactions

    def do_begin(self, d, low):
        if self.work is not None:
            raise SqlError("Cannot begin a transaction inside another")
        self.writable()
        self.work, self.began = self.manifest, self.manifest["tx"]
        return True

    def do_commit(self, d, low):
        if self.work is None:
            raise SqlError("No active transaction")
        try:
            self.check_assertions()
            self.store.publish(self.work, self.clock)
        finally:
            self.manifest, self.work = self.store.latest(), None
            self.savepoints.clear()
        return True

    def do_rollback(self, d, low):
        if self.work is None:
            raise SqlError("No active transaction")
        self.manifest, self.work = self.store.latest(), None
        self.savepoints.clear()
        return True

    def do_savepoint(self, d, low):
        if self.work is None:
            raise SqlError("Savepoints disabled outside a transaction")
        if d["name"] in self.savepoints:
            raise SqlError(f"Duplicate savepoint: {d['name']}")
        self.savepoints[d["name"]] = (time.monotonic(), copy.deepcopy(self.work))
        return True

    def savepoint(self, name: str) -> dict:
        at, held = self.savepoints.get(name, (0.0, None))
        if held is None or time.monotonic() - at > SAVEPOINT_SECONDS:
            raise SqlError(f"No active savepoint: {name}")
        return held

    def do_release(self, d, low):
        self.savepoint(d["name"])
        del self.savepoints[d["name"]]
        return True

    def do_rollback_to(self, d, low):
        self.work = self.manifest = copy.deepcopy(self.savepoint(d["name"]))
        return True

    # -- shared by the statements

    def check_names(self, table: str, names: list[str]) -> None:
        for n in names:
            if n == "system_time":
                raise SqlError("Cannot insert value into SYSTEM_TIME column")
            if not _IDENTIFIER.fullmatch(n):
                raise SqlError(f"Cannot insert into table: {table} invalid column name: {n}")
        if table in self.external or table in self.manifest["views"]:
            raise SqlError(f"Cannot insert into table: {table}")
        meta = self.manifest["tables"].get(table)
        if meta and meta["created"] and set(names) != set(meta["columns"]):
            raise SqlError(f"Cannot insert into table: {table} named columns: {sorted(names)} doesn't match stored: {sorted(meta['columns'])}")


def _has_param(node) -> bool:
    if isinstance(node, tuple):
        return bool(node) and node[0] == "param" and len(node) == 2 or any(map(_has_param, node))
    if isinstance(node, list):
        return any(map(_has_param, node))
    return any(map(_has_param, vars(node).values())) if hasattr(node, "__dict__") else False


def analysis(err: AnalysisException) -> str:
    kind = err.getCondition() if hasattr(err, "getCondition") else ""
    message = str(err).splitlines()[0]
    if kind and "MISSING_AGGREGATION" in kind:
        return f"Selecting columns: that does not match group by ({message})"
    return message


def rows(df: DataFrame) -> list[tuple]:
    """All rows as tuples; for small results."""
    return [tuple(r) for r in df.collect()]


__all__ = ["Session", "SqlError", "rows", "F"]
