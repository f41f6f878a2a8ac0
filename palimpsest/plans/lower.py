"""Name resolution, typing and lowering of queries to Spark SQL text; Catalyst plans the rest."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from itertools import count

from palimpsest.dialect.lexer import SqlError
from palimpsest.dialect.parser import Cte, Query, Select, Source
from palimpsest.functions import scalar as fx
from palimpsest.plans.types import NUMERIC, TEMPORAL, E, ddl, quote, text, unify

AGGREGATES = {"COUNT": (1, 1), "SUM": (1, 1), "TOTAL": (1, 1), "AVG": (1, 1), "MIN": (1, 1), "MAX": (1, 1), "GROUP_CONCAT": (1, 2), "ARRAY_AGG": (1, 1), "OBJECT_AGG": (2, 2)}
TABLE_FUNCTIONS = ("UNNEST", "GENERATE_SERIES")
#: Of a join of periods: the parts of either side where each part meets each, those of the pairs where keys meet, and into how many each partition's rows of one period are split.
GRID, PAIRED, SPLIT = 16, 96, 8


@dataclass
class Rel:
    """A source in scope: how each column is written, and its type. Hidden columns are not part of ``*``."""

    name: str | None
    columns: list[tuple[str, E]]
    hidden: dict[str, E] = field(default_factory=dict)


@dataclass
class Carried:
    """Distinct rows of outer expressions, and how this query sees each."""

    alias: str
    seen: dict[str, str] = field(default_factory=dict)


@dataclass
class Scope:
    """What a query's expressions can name. Of a SELECT also its FROM text, and what it carries from further out to its subqueries."""

    rels: list[Rel]
    parent: Scope | None = None
    source: str | None = None
    carried: dict[str, Carried] | None = None  # FROM text of a query further out -> what is carried of it
    joining: bool = False  # an ON condition is lowered, which takes no correlated aggregates
    near: bool = False  # what the next query up has goes by the carried rows too


@dataclass
class Lowered:
    """SQL of a query and its output columns."""

    sql: str
    columns: list[tuple[str, object]]


def is_aggregate(e) -> bool:
    return e[0] == "func" and e[1] in AGGREGATES and (e[1] not in ("MIN", "MAX") or len(e[2]) == 1)


def children(e):
    """Direct subexpressions, not those inside subqueries."""
    if not isinstance(e, tuple):
        return
    for x in e[1:]:
        if isinstance(x, tuple) and x and isinstance(x[0], str):
            yield x
        elif isinstance(x, list):
            for y in x:
                if isinstance(y, tuple) and y and isinstance(y[0], str):
                    yield y
                elif isinstance(y, tuple):
                    yield from (z for z in y if isinstance(z, tuple) and z and isinstance(z[0], str))


def has_aggregate(e) -> bool:
    return isinstance(e, tuple) and (is_aggregate(e) or any(has_aggregate(x) for x in children(e)))


class Lowering:
    """One statement. ``catalog`` gives tables and runs recursive queries; ``params`` holds values by number or name."""

    def __init__(self, catalog, params=None):
        self.catalog, self.params = catalog, params or {}
        self.used: set = set()
        self.numbers = count()

    def alias(self) -> str:
        return f"q{next(self.numbers)}_"

    # -- queries

    def query(self, q: Query, outer: Scope | None = None, ctes: dict | None = None) -> Lowered:
        ctes = dict(ctes or {})
        if q.ctes:
            self.with_clause(q, outer, ctes)
        body = q.body
        if isinstance(body, Select):
            out = self.select(body, outer, ctes, q)
        elif isinstance(body, Query):
            out = self.query(body, outer, ctes)
            out = self.ordered(out, q)
        elif body[0] == "setop":
            out = self.ordered(self.setop(body, outer, ctes), q)
        elif body[0] == "values":
            out = self.ordered(self.values(body[1], outer, ctes), q)
        else:
            out = self.ordered(self.objects(body[1], outer, ctes), q)
        return Lowered(out.sql + self.limits(q), out.columns)

    def with_clause(self, q: Query, outer, ctes: dict) -> None:
        for c in q.ctes:
            if q.recursive and mentions(c.query, c.name):
                if not c.columns:
                    raise SqlError("WITH RECURSIVE requires named columns")
                ctes[c.name] = self.recursive(c, outer, ctes)
                continue
            if q.recursive and c.columns is None:
                raise SqlError("WITH RECURSIVE requires named columns")
            low = self.query(c.query, outer, ctes)
            ctes[c.name] = renamed(low, c.columns)

    def recursive(self, c: Cte, outer, ctes: dict) -> Lowered:
        body = c.query.body
        if not (isinstance(body, tuple) and body[0] == "setop" and body[1] in ("UNION", "UNION ALL")):
            raise SqlError("Recursion not supported without UNION")
        _, kind, left, right = body
        if mentions(left, c.name):
            raise SqlError("Left recursion not supported")
        if isinstance(right, Select) and sum(mentions(s, c.name) for s in flat(right.sources)) > 1:
            raise SqlError("Non-linear recursion not supported")
        if isinstance(right, Select) and any(has_aggregate(e) for e, _ in right.items):
            raise SqlError("Recursion not supported with aggregates")
        base = renamed(self.term(left, outer, ctes), c.columns)

        def step(view: str, columns):
            inner = dict(ctes)
            inner[c.name] = Lowered(f"SELECT * FROM {view}", columns)
            return renamed(self.term(right, outer, inner), c.columns)

        return self.catalog.recursive(base, step, kind == "UNION ALL", c.query)

    def term(self, body, outer, ctes) -> Lowered:
        return self.query(body if isinstance(body, Query) else Query(body), outer, ctes)

    def setop(self, body, outer, ctes) -> Lowered:
        _, op, left, right = body
        a, b = (self.term(x, outer, ctes) if not (isinstance(x, tuple) and x[0] == "setop") else self.setop(x, outer, ctes) for x in (left, right))
        if len(a.columns) != len(b.columns):
            raise SqlError(f"Number of {op.split()[0]} left columns: {len(a.columns)} does not match right columns: {len(b.columns)}")
        types = [unify(x, y) for (_, x), (_, y) in zip(a.columns, b.columns, strict=True)]
        sides = [self.as_types(x, types) for x in (a, b)]
        names = [(n, t) for (n, _), t in zip(a.columns, types, strict=True)]
        return Lowered(f"SELECT * FROM ({sides[0].sql}) {op} SELECT * FROM ({sides[1].sql})", names)

    def as_types(self, q: Lowered, types: list) -> Lowered:
        """``q`` with its columns numbered, and cast where the types differ."""
        a = self.alias()
        if all(t == x for (_, x), t in zip(q.columns, types, strict=True)):
            return q
        inner = ", ".join(f"c{i}_" for i in range(len(types)))
        cols = ", ".join(f"{fx.cast_to(E(f'c{i}_', x), t)} AS {quote(n)}" for i, ((n, x), t) in enumerate(zip(q.columns, types, strict=True)))
        return Lowered(f"SELECT {cols} FROM ({q.sql}) AS {a}({inner})", [(n, t) for (n, _), t in zip(q.columns, types, strict=True)])

    def ordered(self, out: Lowered, q: Query) -> Lowered:
        if not q.order:
            return out
        keys = []
        for e, down in q.order:
            n = self.position(e, out.columns)
            if n is None:
                raise SqlError("Invalid ORDER BY expression")
            keys.append(f"{n + 1} {'DESC' if down else 'ASC'}")
        return Lowered(f"SELECT * FROM ({out.sql}) ORDER BY {', '.join(keys)}", out.columns)

    def position(self, e, columns) -> int | None:
        """The output column that an ORDER BY item names by number or name."""
        if e[0] == "lit" and e[2] == "int":
            if not 1 <= e[1] <= len(columns):
                raise SqlError(f"ORDER BY index not in range: {e[1]}")
            return e[1] - 1
        if e[0] == "name" and len(e[1]) == 1:
            for i, (n, _) in enumerate(columns):
                if n == e[1][0]:
                    return i
        return None

    def limits(self, q: Query) -> str:
        out = ""
        for word, e in (("LIMIT", q.limit), ("OFFSET", q.offset)):
            if e is not None:
                v = self.expr(e, Scope([]), {})
                if not v.is_const or not isinstance(v.const, int):
                    raise SqlError(f"{word} must be a number")
                out += f" {word} {v.const}"
        return out

    def values(self, rows, outer, ctes) -> Lowered:
        if len({len(r) for r in rows}) != 1:
            raise SqlError("All VALUES must have the same number of columns")
        low = [[self.expr(e, Scope([], outer), ctes) for e in r] for r in rows]
        names = [f"column{i + 1}" for i in range(len(rows[0]))]
        return self.inline(low, names)

    def inline(self, rows: list[list[E]], names: list[str]) -> Lowered:
        types = ["null"] * len(names)
        for r in rows:
            types = [unify(t, x.type) for t, x in zip(types, r, strict=True)]
        cells = [", ".join(fx.null_of(t) if x.type == "null" else fx.cast_to(x, t) for x, t in zip(r, types, strict=True)) for r in rows]
        if any(not x.is_const or x.type == "doc" or isinstance(x.type, tuple) or t == "doc" or isinstance(t, tuple) for r in rows for x, t in zip(r, types, strict=True)):
            cols = lambda r: ", ".join(f"{fx.null_of(t) if x.type == 'null' else fx.cast_to(x, t)} AS {quote(n)}" for x, t, n in zip(r, types, names, strict=True))
            return Lowered(" UNION ALL ".join(f"SELECT {cols(r)}" for r in rows), list(zip(names, types, strict=True)))
        return Lowered(f"SELECT * FROM VALUES {', '.join(f'({c})' for c in cells)} AS {self.alias()}({', '.join(map(quote, names))})", list(zip(names, types, strict=True)))

    def objects(self, rows, outer, ctes) -> Lowered:
        found = []
        for r in rows:
            if r[0] == "param":
                v = self.param(r[1])
                if not isinstance(v, dict):
                    raise SqlError("All OBJECTS must have literal keys")
                found.append({str(k): fx.literal(x) for k, x in v.items()})
                continue
            row = {}
            for kind, *rest in r[1]:
                if kind != "kv":
                    raise SqlError("All OBJECTS must have literal keys")
                row[rest[0]] = self.expr(rest[1], Scope([], outer), ctes)
            found.append(row)
        names = sorted({k for r in found for k in r})
        if not names:
            raise SqlError("Cannot insert empty object")
        return self.inline([[r.get(n, fx.NULL) for n in names] for r in found], names)

    # -- SELECT

    def select(self, s: Select, outer, ctes, q: Query) -> Lowered:
        scope = Scope([], outer, carried={})
        s = unjoined(s)
        parts = self.sources(s.sources, scope, ctes)
        scope.source = " CROSS JOIN ".join(parts)
        items = self.items(s, scope, ctes)
        grouped = s.group is not None or s.having is not None or any(has_aggregate(e) for e, _ in s.items if e[0] != "star") or any(has_aggregate(e) for e, _ in q.order)
        columns = [(n, e.type) for n, e in items]
        if s.where is not None and has_aggregate(s.where):
            raise SqlError("Cannot use aggregate functions in WHERE")
        tests = [self.condition(s.where, scope, ctes)] if s.where is not None else []
        if tests and scope.carried:  # once more: what the condition has of the same outer query comes in the same rows, so that these join by it
            scope.near = True
            tests = [self.condition(s.where, scope, ctes)]
            scope.near = False
        group = [self.group_key(e, scope, ctes) for e in s.group or []]
        having = f" HAVING {fx.boolean(self.expr(s.having, scope, ctes))}" if s.having is not None else ""
        if grouped:
            self.check_grouping(s, scope)
        order = self.order_keys(s, q, columns, scope, ctes)
        source = scope.source
        if s.where is not None and len(parts) == 2 and (met := self.period_join(s, parts, scope, ctes, " ".join([*(e.sql for _, e in items), *group, having, order]))):
            source, tests = met
        # a subquery sees one query up only: what is further out comes as distinct rows, joined by equality
        carried = [(c.alias, values, list(c.seen.items())) for values, c in scope.carried.items()]
        sources = [f"(SELECT DISTINCT {', '.join(f'{e} AS k{i}_' for i, (e, _) in enumerate(seen))} FROM {values}) AS {a}" for a, values, seen in carried] + ([source] if source else [])
        tests += [f"{a}.k{i}_ <=> {x}" for a, _, seen in carried for i, (_, x) in enumerate(seen)]
        group += [f"{a}.k{i}_" for a, _, seen in carried for i in range(len(seen))] if group else []
        sql = "SELECT " + "DISTINCT " * s.distinct + ", ".join(f"{fx.null_of(e.type) if e.type == 'null' else e.sql} AS {quote(n)}" for n, e in items)
        sql += f" FROM {' CROSS JOIN '.join(sources)}" if sources else ""
        sql += f" WHERE {' AND '.join(tests)}" if tests else ""
        sql += f" GROUP BY {', '.join(group)}" if group else ""
        return Lowered(sql + having + order, columns)

    def period_join(self, s: Select, parts: list[str], scope: Scope, ctes, rest: str) -> tuple[str, list[str]] | None:
        """FROM text and conditions of a join of two sources by one predicate on periods; None for any other query.

        The bounds are computed once a row. Rows with the same bounds are gathered, few enough at a time, and meet as a whole; each pair
        is then written out in place, so that the work is that of the rows returned and lies in even shares on all tasks.
        """
        if scope.parent or scope.carried or any(x.kind not in ("table", "query") or x.lateral for x in s.sources) or not all(r.columns for r in scope.rels):
            return None
        names = [re.match(r"q\d+_(?=\.)", r.columns[0][1].sql)[0] for r in scope.rels]
        kind, pair, own, tests = None, [], {n: [] for n in names}, []
        for e in conjuncts(s.where):
            if e[0] == "func" and e[1] in fx.PERIODS and kind is None:
                pair = [self.expr(x, scope, ctes) for x in e[2]]
                if any(x.type == "null" or unmoved(x.sql) for x in pair) or sorted(map(of, (x.sql for x in pair))) != sorted(map(of, (f"{n}." for n in names))):
                    return None
                kind = e[1]
                continue
            sql = self.condition(e, scope, ctes)
            if unmoved(sql) or of(sql) not in ([], *([n] for n in names)):
                return None
            (own[of(sql)[0]] if of(sql) else tests).append(sql)
        if kind is None or unmoved(rest):
            return None
        rest = " ".join([rest, *tests])
        used = {n: [(e.sql, e.type) for _, e in r.columns if e.sql in rest] for n, r in zip(names, scope.rels, strict=True)}
        for sql, _ in (c for cols in used.values() for c in cols):
            rest = rest.replace(sql, "")
        if of(rest):  # hidden columns
            return None
        bounds = fx.period_bounds(kind, *pair)
        keyed = all(op == "=" for _, op, _ in bounds)
        sides = {}
        for side, x in enumerate(pair):
            n = of(x.sql)[0]
            keys = [b[2 * side] for b in bounds]
            fields = ", ".join(f"'u{i}', {sql}" for i, (sql, _) in enumerate(used[n])) or "'u0', true"
            plain = [sql for sql, t in used[n] if isinstance(t, str) and t not in ("null", "time")]
            inner = ", ".join([*(f"{k} AS k{i}_" for i, k in enumerate(keys)), f"named_struct({fields}) AS row_", "spark_partition_id() AS p_", f"pmod(xxhash64({', '.join(plain)}), {SPLIT}) AS h_" if plain else "0 AS h_"])
            tested = f" WHERE {' AND '.join(own[n])}" if own[n] else ""
            held = ", ".join(f"k{i}_" for i in range(len(keys)))
            gathered = f"SELECT {held}, collect_list(row_) AS rows_ FROM (SELECT {inner} FROM {parts[names.index(n)]}{tested}) GROUP BY {held}, p_, h_"
            sides[n] = gathered if keyed else f"SELECT /*+ REPARTITION({GRID}) */ * FROM ({gathered})"
        left, right = sides
        on = " AND ".join(f"{left}.k{i}_ {op} {right}.k{i}_" for i, (_, op, _) in enumerate(bounds))
        hint = f"REPARTITION({PAIRED})" if keyed else f"SHUFFLE_REPLICATE_NL({left})"
        a = self.alias()
        source = f"(SELECT /*+ {hint} */ {left}.rows_ AS l_, {right}.rows_ AS r_ FROM ({sides[left]}) AS {left} JOIN ({sides[right]}) AS {right} ON {on}) AS {a}"
        for n, rows in ((left, "l_"), (right, "r_")):
            source += f" LATERAL VIEW inline({a}.{rows}) {n} AS {', '.join(sql.removeprefix(f'{n}.') for sql, _ in used[n]) or 'u0_'}"
        return source, tests

    def order_keys(self, s: Select, q: Query, columns, scope: Scope, ctes) -> str:
        keys = []
        for e, down in q.order:
            n = self.position(e, columns)
            if n is not None:
                key = str(n + 1)
            elif s.distinct:
                raise SqlError("Invalid ORDER BY expression")
            else:
                if e[0] == "name" and not self.known(e[1], scope):
                    raise SqlError(f"Cannot resolve ORDER BY column: {'.'.join(e[1])}")
                key = self.expr(e, scope, ctes).sql
            keys.append(f"{key} {'DESC' if down else 'ASC'}")
        return f" ORDER BY {', '.join(keys)}" if keys else ""

    def group_key(self, e, scope, ctes) -> str:
        if has_aggregate(e):
            raise SqlError("Cannot use aggregate functions in GROUP BY")
        x = self.expr(e, scope, ctes)
        return f"({x.sql})" if x.is_const else x.sql

    def check_grouping(self, s: Select, scope: Scope) -> None:
        """Columns outside aggregates must be in the group keys."""
        keys = [strip(e) for e in s.group or []]
        bad: list[str] = []

        def walk(e):
            if not isinstance(e, tuple) or strip(e) in keys or is_aggregate(e):
                return
            if e[0] == "name" and self.local(e[1], scope) and not any(k[0] == "name" and k[1][-1] == e[1][-1] for k in keys):
                bad.append(".".join(e[1]))
            for x in children(e):
                walk(x)

        for e, _ in s.items:
            if e[0] == "star":
                if not s.group:
                    bad.append("*")
            else:
                walk(e)
        if bad:
            raise SqlError(f"Selecting columns: {bad} that does not match group by: {['.'.join(k[1]) if k[0] == 'name' else '..' for k in keys]}")

    def items(self, s: Select, scope: Scope, ctes) -> list[tuple[str, E]]:
        out = []
        for e, alias in s.items:
            if e[0] == "star":
                rels = scope.rels if e[1] is None else [r for r in scope.rels if r.name == e[1]]
                if not rels:
                    raise SqlError(f"Unknown table: {e[1] or ''}")
                out += [c for r in rels for c in r.columns]
                continue
            name = alias or self.name_of(e) or f"column{len(out) + 1}"
            out.append((name, self.expr(e, scope, ctes)))
        return out

    def name_of(self, e) -> str | None:
        if e[0] == "group":
            return self.name_of(e[1])
        if e[0] == "name":
            return e[1][-1]
        if e[0] == "access" and e[2][0] == "key":
            return e[2][1]
        return None

    # -- FROM

    def sources(self, sources: list[Source], scope: Scope, ctes) -> list[str]:
        return [self.source(s, scope, ctes, first=not i) for i, s in enumerate(sources)]

    def source(self, s: Source, scope: Scope, ctes, first: bool = False) -> str:
        if s.kind == "join":
            before = len(scope.rels)
            left = self.source(s.left, scope, ctes, first)
            middle = len(scope.rels)
            right = self.source(s.right, scope, ctes)
            if s.right.kind == "join":
                right = f"({right})"
            on = None
            if s.using:
                on = " AND ".join(self.using(scope.rels[before:middle], scope.rels[middle:], c) for c in s.using)
            elif s.on is not None:
                scope.joining = True
                on = self.condition(s.on, scope, ctes)
                scope.joining = False
            if s.how == "cross" or on is None and s.how == "inner":
                return f"{left} CROSS JOIN {right}" + (f" ON {on}" if on else "")
            return f"{left} {'LEFT' if s.how == 'left' else 'INNER'} JOIN {right} ON {on or 'true'}"
        if s.kind == "function":
            return self.table_function(s, scope, ctes, first)
        a = self.alias()
        if s.kind == "query":
            low = renamed(self.query(s.query, scope if s.lateral else scope.parent, ctes), s.columns)
            if not s.alias:
                raise SqlError("A subquery needs an alias", s.at)
            names = unique(low.columns)
            scope.rels.append(Rel(s.alias, [(n, E(f"{a}.{quote(u)}", t)) for (n, t), u in zip(low.columns, names, strict=True)]))
            return f"{'LATERAL ' if s.lateral and not first else ''}({low.sql}) AS {a}({', '.join(map(quote, names))})"
        if s.name in ctes and not s.system_time:
            low = renamed(ctes[s.name], s.columns)
            names = unique(low.columns)
            scope.rels.append(Rel(s.alias or s.name, [(n, E(f"{a}.{quote(u)}", t)) for (n, t), u in zip(low.columns, names, strict=True)]))
            return f"({low.sql}) AS {a}({', '.join(map(quote, names))})"
        period = None
        if s.system_time:
            times = [self.expr(e, Scope([]), {}) for e in s.system_time[1:]]
            for t in times:
                if t.type not in ("date", "timestamp"):
                    raise SqlError("SYSTEM_TIME start/end must be a date or timestamp")
            period = (s.system_time[0], *(t.sql for t in times))
        found = self.catalog.table(s.name, period, self)
        if found is None:
            raise SqlError(f"Unknown table: {s.name}", s.at)
        sql, columns, hidden = found
        if s.columns:
            if len(s.columns) != len(columns):
                raise SqlError("Number of column names does not match projection")
        shown = [(n if not s.columns else s.columns[i], E(f"{a}.{quote(n)}", t)) for i, (n, t) in enumerate(columns)]
        scope.rels.append(Rel(s.alias or s.name, shown, {n: E(x.sql.format(a=a), x.type) for n, x in hidden.items()}))
        return f"{sql} AS {a}"

    def using(self, left: list[Rel], right: list[Rel], name: str) -> str:
        pair = []
        for rels in (left, right):
            found = [e for r in rels for n, e in r.columns if n == name]
            if not found:
                raise SqlError(f"Unknown column: {name}")
            pair.append(found[0])
        return fx.compare("=", *pair).sql

    def table_function(self, s: Source, scope: Scope, ctes, first: bool) -> str:
        if s.name not in TABLE_FUNCTIONS:
            raise SqlError(f"Unknown table function: {s.name}", s.at)
        args = [self.expr(e, scope, ctes) for e in s.args]
        a = self.alias()
        lateral = "" if first else "LATERAL "
        if s.name == "GENERATE_SERIES":
            if not 2 <= len(args) <= 3:
                raise SqlError(f"Invalid number of arguments: {len(args)} to: GENERATE_SERIES min: 2 max: 3")
            start, stop = args[0], args[1]
            by = args[2] if len(args) > 2 else fx.literal(1) if start.type == "integer" else fx.literal((0, 1, 0), "interval")
            if all(x.type == "integer" and x.is_const for x in (start, stop, by)):
                last = stop.const + (1 if by.const > 0 else -1)
                sql, cols = f"(SELECT id AS value FROM range({start.const}, {last}, {by.const}, {max(1, min(200, abs(last - start.const) // 1_000_000 + 1))})) AS {a}", [("value", E(f"{a}.value", "integer"))]
            else:
                step = by.sql if by.type != "interval" else fx.calendar(by.sql)
                up = f"{by.sql} > 0" if by.type == "integer" else "true"
                t = start.type if start.type == stop.type else unify(start.type, stop.type)
                x, y = fx.cast_to(start, t), fx.cast_to(stop, t)
                seq = f"CASE WHEN ({up}) = ({x} <= {y}) OR {x} = {y} THEN sequence({x}, {y}, {step}) END"
                sql, cols = f"{lateral}explode({seq}) AS {a}(value)", [("value", E(f"{a}.value", t))]
            if s.ordinality:
                raise SqlError("WITH ORDINALITY is for UNNEST")
        else:
            if not args:
                raise SqlError("Invalid number of arguments: 0 to: UNNEST min: 1 max: 99")
            arrays = [self.unnestable(x) for x in args]
            if len(arrays) == 1:
                sql, cols = f"posexplode({arrays[0][0]}) AS {a}(o_, v0)", [("column1", E(f"{a}.v0", arrays[0][1]))]
            else:
                zipped = f"arrays_zip({', '.join(f'transform({x}, x_ -> x_)' for x, _ in arrays)})"
                sql = f"posexplode({zipped}) AS {a}(o_, z_)"
                cols = [(f"column{i + 1}", E(f"{a}.z_.`{i}`", t)) for i, (_, t) in enumerate(arrays)]
            sql = lateral + sql
            if s.ordinality:
                cols.append((f"column{len(cols) + 1}", E(f"CAST({a}.o_ AS BIGINT)", "integer")))
        if not s.alias:
            raise SqlError("A table function needs an alias", s.at)
        if s.columns:
            if len(s.columns) != len(cols):
                raise SqlError("Number of column names does not match projection")
            cols = [(n, e) for n, (_, e) in zip(s.columns, cols, strict=True)]
        scope.rels.append(Rel(s.alias, cols))
        return sql

    def unnestable(self, x: E) -> tuple[str, object]:
        if isinstance(x.type, tuple) and x.type[0] == "array":
            return x.sql, x.type[1] if x.type[1] != "null" else "text"
        if x.type == "doc" or isinstance(x.type, tuple):
            return f"pl_elements({fx.to_doc(x)})", "doc"
        return "CAST(array() AS ARRAY<STRING>)", "text"

    # -- names

    def local(self, path: list[str], scope: Scope) -> bool:
        return self.find(path, Scope(scope.rels)) is not None

    def known(self, path, scope) -> bool:
        return self.find(path, scope) is not None

    def find(self, path: list[str], scope: Scope | None) -> E | None:
        """A column by its longest known prefix, then steps into it; from the innermost query outwards."""
        between = []
        while scope is not None:
            found = self.within(path, scope)
            if found is not None:
                near = bool(between) and between[0].near and scope.source in between[0].carried
                return self.carry(found, between if near else between[1:], scope)
            between.append(scope)
            scope = scope.parent
        return None

    def within(self, path: list[str], scope: Scope) -> E | None:
        if len(path) >= 2:
            for r in scope.rels:
                if r.name == path[0]:
                    e = dict(r.columns).get(path[1]) or r.hidden.get(path[1])
                    if e is not None:
                        return self.steps(e, path[2:])
        found = [e for r in scope.rels for n, e in r.columns if n == path[0]]
        if found:
            return self.steps(found[0], path[1:])
        hidden = [r.hidden[path[0]] for r in scope.rels if path[0] in r.hidden]
        if hidden:
            return self.steps(hidden[0], path[1:])
        for r in scope.rels:
            if r.name == path[0] and len(path) == 1:
                return fx.object_of(r.columns)
        return None

    def carry(self, e: E, between: list[Scope], owner: Scope) -> E:
        """``e`` of a query two or more levels up, by way of the queries between: each joins its distinct rows on equality."""
        seen = e
        for scope in reversed(between):
            if scope.carried is None or not owner.source:
                raise SqlError("Cannot correlate through this query to one further out")
            if owner.source not in scope.carried:
                scope.carried[owner.source] = Carried(self.alias())
            c = scope.carried[owner.source]
            c.seen.setdefault(e.sql, seen.sql)
            seen = E(f"{c.alias}.k{list(c.seen).index(e.sql)}_", e.type)
        return seen

    def steps(self, e: E, path: list[str]) -> E:
        for p in path:
            e = fx.access(e, ("key", p))
        return e

    def param(self, key):
        if key not in self.params:
            raise SqlError(f"Required parameters: {key} does not match given: {sorted(map(str, self.params))}")
        self.used.add(key)
        return self.params[key]

    # -- expressions

    def condition(self, e, scope, ctes) -> str:
        return fx.boolean(self.expr(e, scope, ctes, where=True))

    def expr(self, e, scope: Scope, ctes: dict, where: bool = False) -> E:
        return getattr(self, "e_" + e[0])(e, scope, ctes, where)

    def e_group(self, e, scope, ctes, where) -> E:
        return self.expr(e[1], scope, ctes)

    def e_lit(self, e, scope, ctes, where) -> E:
        _, v, kind = e
        if kind == "date":
            return E(f"DATE'{v}'", "date", v, True)
        if kind == "ts":
            return E(f"TIMESTAMP'{v}'", "timestamp", v, True)
        if kind == "time":
            return E(f"TIME'{v}'", "time", v, True)
        if kind == "path":
            return E(text(json.dumps(v)), "doc", v, True)
        return fx.literal(v, "interval" if kind == "interval" else None)

    def e_now(self, e, scope, ctes, where) -> E:
        now = fx.literal(self.catalog.now())
        if e[1] == "CURRENT_DATE":
            return E(f"CAST({now.sql} AS DATE)", "date")
        return now if e[1] == "CURRENT_TIMESTAMP" else E(f"CAST(date_format({now.sql}, 'HH:mm:ss.SSSSSS') AS TIME(6))", "time")

    def e_param(self, e, scope, ctes, where) -> E:
        return fx.literal(self.param(e[1]))

    def e_name(self, e, scope, ctes, where) -> E:
        found = self.find(e[1], scope)
        if found is None:
            raise SqlError(f"Unknown column: {'.'.join(e[1])}", e[2])
        return found

    def e_and(self, e, scope, ctes, where) -> E:
        return E(f"({fx.boolean(self.expr(e[1], scope, ctes, where))} AND {fx.boolean(self.expr(e[2], scope, ctes, where))})", "boolean")

    def e_or(self, e, scope, ctes, where) -> E:
        return E(f"({fx.boolean(self.expr(e[1], scope, ctes))} OR {fx.boolean(self.expr(e[2], scope, ctes))})", "boolean")

    def e_not(self, e, scope, ctes, where) -> E:
        return E(f"(NOT {fx.boolean(self.expr(e[1], scope, ctes, where))})", "boolean")

    def e_un(self, e, scope, ctes, where) -> E:
        x = self.expr(e[2], scope, ctes)
        if e[1] == "~":
            return fx.NULL if x.type == "null" else E(f"(~{fx.whole(x)})", "integer")
        if x.type == "interval":
            return x if e[1] == "+" else E(f"named_struct('months', -{x.sql}.months, 'days', -{x.sql}.days, 'nanos', -{x.sql}.nanos)", "interval")
        if x.type == "null":
            return x
        n = fx.number(x)
        return n if e[1] == "+" else E(f"(-{n.sql})", n.type)

    def e_bin(self, e, scope, ctes, where) -> E:
        op = e[1]
        a, b = self.expr(e[2], scope, ctes), self.expr(e[3], scope, ctes)
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return fx.compare(op, a, b)
        if op == "||":
            return fx.concat(a, b)
        if op == "<->":
            return fx.l2_distance(a, b)
        if op == "<#>":
            return fx.inner_product(a, b, "-")
        if op == "<=>":
            return fx.cosine_distance(a, b)
        return fx.arithmetic(op, a, b)

    def e_is(self, e, scope, ctes, where) -> E:
        x = fx.identical(self.expr(e[1], scope, ctes), self.expr(e[2], scope, ctes), strict=True)
        return E(f"(NOT ({x.sql}))", "boolean") if e[3] else E(f"({x.sql})", "boolean")

    def e_distinct(self, e, scope, ctes, where) -> E:
        x = fx.identical(self.expr(e[1], scope, ctes), self.expr(e[2], scope, ctes), strict=False)
        return E(f"(NOT ({x.sql}))", "boolean") if e[3] else E(f"({x.sql})", "boolean")

    def e_between(self, e, scope, ctes, where) -> E:
        x, a, b = (self.expr(y, scope, ctes) for y in e[1:4])
        out = f"({fx.compare('>=', x, a).sql} AND {fx.compare('<=', x, b).sql})"
        return E(f"(NOT {out})" if e[4] else out, "boolean")

    def e_in_list(self, e, scope, ctes, where) -> E:
        x = self.expr(e[1], scope, ctes)
        items = [self.expr(y, scope, ctes) for y in e[2]]
        same = [y for y in items if y.type == x.type or x.type in NUMERIC and y.type in NUMERIC]
        if not items:
            return E("true" if e[3] else "false", "boolean")
        if len(same) == len(items) and isinstance(x.type, str):
            return E(f"({x.sql} {'NOT ' * e[3]}IN ({', '.join(y.sql for y in items)}))", "boolean")
        out = "(" + " OR ".join(fx.compare("=", x, y).sql for y in items) + ")"
        return E(f"(NOT {out})" if e[3] else out, "boolean")

    def single(self, q: Query, scope, ctes, what: str) -> Lowered:
        low = self.query(q, scope, ctes)
        if len(low.columns) != 1:
            raise SqlError(f"{what} must return single column")
        return low

    def e_in_query(self, e, scope, ctes, where) -> E:
        x = self.expr(e[1], scope, ctes)
        low = self.single(e[2], scope, ctes, "IN query")
        t = low.columns[0][1]
        if where and (x.type == t or x.type in NUMERIC and t in NUMERIC):
            return E(f"({x.sql} {'NOT ' * e[3]}IN ({low.sql}))", "boolean")
        out = self.any_of("=", x, low, scope)
        return E(f"(NOT {out})" if e[3] else out, "boolean")

    def any_of(self, op: str, x: E, low: Lowered, scope: Scope) -> str:
        """Whether ``x`` compares to any value of a query, in three values. Simple types go by the least and greatest value and by counts, so that no row meets all values."""
        a, t = self.alias(), low.columns[0][1]
        if not scope.joining and any(x.type in kinds and t in kinds for kinds in (NUMERIC, TEMPORAL, ("text",))):
            values = f"FROM ({low.sql}) AS {a}(c_)"
            least, most = (E(f"(SELECT {f}({a}.c_) {values})", t) for f in ("min", "max"))
            arms = [fx.compare(op, x, e).sql for e in {"=": [], "<>": [least, most], "<": [most], "<=": [most], ">": [least], ">=": [least]}[op]]
            if op == "=":
                arms = [f"EXISTS (SELECT 1 {values} WHERE {fx.compare(op, x, E(f'{a}.c_', t)).sql})"]
            nulls = f"coalesce((SELECT CASE WHEN count(1) = 0 THEN 0 WHEN count({a}.c_) = count(1) THEN 1 ELSE 2 END {values}), 0)"
            return f"CASE {' '.join(f'WHEN {y} THEN true' for y in arms)} WHEN {nulls} > CASE WHEN {x.sql} IS NULL THEN 0 ELSE 1 END THEN CAST(NULL AS BOOLEAN) ELSE false END"
        c = E(f"{a}.c_", t)
        test = fx.compare(op, x, c).sql
        inner = f"SELECT 1 FROM ({low.sql}) AS {a}(c_) WHERE"
        return f"CASE WHEN EXISTS ({inner} {test}) THEN true WHEN EXISTS ({inner} ({test}) IS NULL) THEN CAST(NULL AS BOOLEAN) ELSE false END"

    def e_quant(self, e, scope, ctes, where) -> E:
        _, op, left, kind, q = e
        x = self.expr(left, scope, ctes)
        low = self.single(q, scope, ctes, f"{kind.upper()} query")
        if kind == "any":
            return E(f"({self.any_of(op, x, low, scope)})", "boolean")
        inverse = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}[op]
        return E(f"(NOT ({self.any_of(inverse, x, low, scope)}))", "boolean")

    def e_exists(self, e, scope, ctes, where) -> E:
        return E(f"EXISTS ({self.query(e[1], scope, ctes).sql})", "boolean")

    def e_scalar(self, e, scope, ctes, where) -> E:
        low = self.single(e[1], scope, ctes, "Scalar subquery")
        return E(f"({low.sql})", low.columns[0][1])

    def e_array_query(self, e, scope, ctes, where) -> E:
        low = self.single(e[1], scope, ctes, "ARRAY query")
        a, t = self.alias(), low.columns[0][1]
        t = "text" if t == "null" else t
        if e[1].order:
            ranked = f"SELECT c_, row_number() OVER (ORDER BY n_) AS r_ FROM (SELECT c_, monotonically_increasing_id() AS n_ FROM ({low.sql}) AS {a}(c_))"
            return E(f"(SELECT transform(array_sort(collect_list(struct(r_, c_))), x_ -> x_.c_) FROM ({ranked}))", ("array", t))
        return E(f"(SELECT transform(collect_list(struct({a}.c_)), x_ -> x_.c_) FROM ({low.sql}) AS {a}(c_))", ("array", t))

    def e_like(self, e, scope, ctes, where) -> E:
        _, kind, value, pattern, escape = e
        return fx.like(kind, self.expr(value, scope, ctes), self.expr(pattern, scope, ctes), self.expr(escape, scope, ctes) if escape else None)

    def e_case(self, e, scope, ctes, where) -> E:
        _, base, arms, other = e
        b = self.expr(base, scope, ctes) if base else None
        tests = [(fx.compare("=", b, self.expr(c, scope, ctes)).sql if b else fx.boolean(self.expr(c, scope, ctes)), self.expr(v, scope, ctes)) for c, v in arms]
        return fx.choose(tests, self.expr(other, scope, ctes) if other else fx.NULL)

    def e_cast(self, e, scope, ctes, where) -> E:
        return fx.cast(self.expr(e[1], scope, ctes), e[2], e[3])

    def e_array(self, e, scope, ctes, where) -> E:
        parts = [(k == "spread", self.expr(x, scope, ctes)) for k, x in e[1]]
        if not any(s for s, _ in parts):
            return fx.array_of([x for _, x in parts])
        if all(isinstance(x.type, tuple) and x.type[0] == "array" if s else True for s, x in parts):
            kinds = {x.type[1] if s else x.type for s, x in parts} - {"null"}
            if len(kinds) <= 1 and (not kinds or isinstance(next(iter(kinds)), str)):
                t = next(iter(kinds), "text")
                sides = [f"CAST({x.sql} AS {ddl(('array', t))})" if s else f"array(CAST({x.sql} AS {ddl(t)}))" for s, x in parts]
                return E(f"concat({', '.join(sides)})", ("array", t))
        cells = ", ".join(f"concat('[{'true' if s else 'false'},', coalesce({fx.to_doc(x)}, 'null'), ']')" for s, x in parts)
        return E(f"pl_array(concat('[', concat_ws(',', {cells}), ']'))", "doc")

    def e_object(self, e, scope, ctes, where) -> E:
        parts: list[tuple] = []
        for kind, *rest in e[1]:
            if kind == "kv":
                parts.append(("kv", rest[0], self.expr(rest[1], scope, ctes)))
            elif kind == "computed":
                key = self.expr(rest[0], scope, ctes)
                parts.append(("kv", key.const, self.expr(rest[1], scope, ctes)) if key.is_const and isinstance(key.const, str) else ("computed", key, self.expr(rest[1], scope, ctes)))
            elif kind == "star":
                rels = [r for r in scope.rels if r.name == rest[0]]
                if not rels:
                    raise SqlError(f"Unknown table: {rest[0]}")
                parts += [("kv", n, x) for n, x in rels[0].columns]
            else:
                x = self.expr(rest[0], scope, ctes)
                if isinstance(x.type, tuple) and x.type[0] == "object":
                    parts += [("kv", k, E(f"{x.sql}.{quote(k)}", t)) for k, t in x.type[1]]
                else:
                    parts.append(("spread", None, x))
        if all(p[0] == "kv" for p in parts):
            return fx.object_of([(k, x) for _, k, x in parts])
        cells = []
        for kind, key, x in parts:
            k = text(json.dumps(key, ensure_ascii=False)) if kind == "kv" else f"coalesce({fx.to_doc(key)}, 'null')" if kind == "computed" else "'null'"
            cells.append(f"concat('[{'true' if kind == 'spread' else 'false'},', {k}, ',', coalesce({fx.to_doc(x)}, 'null'), ']')")
        return E(f"pl_object(concat('[', concat_ws(',', {', '.join(cells)}), ']'))", "doc")

    def e_access(self, e, scope, ctes, where) -> E:
        base, step = self.expr(e[1], scope, ctes), e[2]
        if step[0] in ("index", "deep") and step[1] is not None:
            step = (step[0], self.expr(step[1], scope, ctes))
        return fx.access(base, step)

    def e_func(self, e, scope, ctes, where) -> E:
        name, args = e[1], e[2]
        extra = e[3] if len(e) > 3 else {"star": False, "distinct": False, "order": [], "filter": None}
        if is_aggregate(e) or name in AGGREGATES and (extra["star"] or name not in ("MIN", "MAX")):
            return self.aggregate(name, args, extra, scope, ctes)
        if name in TABLE_FUNCTIONS:
            raise SqlError(f"Cannot use table function outside FROM: {name}")
        if name not in fx.FUNCTIONS:
            raise SqlError(f"Unknown built-in function: {name}")
        least, most, build = fx.FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise SqlError(f"Invalid number of arguments: {len(args)} to: {name} min: {least} max: {most}")
        low = [self.expr(a, scope, ctes) for a in args]
        try:
            return build(*low)
        except (KeyError, AttributeError, TypeError) as err:
            raise SqlError(f"Invalid argument types: {name}({', '.join(map(str, (x.type for x in low)))})") from err

    def aggregate(self, name: str, args, extra, scope, ctes) -> E:
        least, most = AGGREGATES[name]
        if not extra["star"] and not least <= len(args) <= most:
            raise SqlError(f"Invalid number of arguments: {len(args)} to: {name} min: {least} max: {most}")
        if any(has_aggregate(a) for a in args):
            raise SqlError("Cannot nest aggregate functions")
        low = [self.expr(a, scope, ctes) for a in args]
        where = f" FILTER (WHERE {fx.boolean(self.expr(extra['filter'], scope, ctes))})" if extra["filter"] is not None else ""
        once = "DISTINCT " if extra["distinct"] else ""
        if name == "COUNT":
            if extra["star"]:
                return E(f"count(1){where}", "integer")
            return E(f"count({once}{low[0].sql}){where}", "integer")
        if extra["star"]:
            raise SqlError(f"Invalid number of arguments: 0 to: {name} min: {least} max: {most}")
        x = low[0]
        if name in ("SUM", "TOTAL", "AVG"):
            n = fx.number(x)
            n = E("CAST(NULL AS BIGINT)", "integer") if n.type == "null" else n
            if name == "SUM":
                return E(f"sum({once}{n.sql}){where}", n.type)
            if name == "TOTAL":
                return E(f"coalesce(sum({once}CAST({n.sql} AS DOUBLE)){where}, 0D)", "real")
            return E(f"avg({once}CAST({n.sql} AS DOUBLE)){where}", "real")
        if name in ("MIN", "MAX"):
            return fx.NULL if x.type == "null" else E(f"{name.lower()}({x.sql}){where}", x.type)
        order = [(self.expr(k, scope, ctes).sql, down) for k, down in extra["order"]]
        if name == "GROUP_CONCAT":
            if extra["distinct"] and len(low) > 1:
                raise SqlError("GROUP_CONCAT with DISTINCT takes no separator")
            sep = low[1].sql if len(low) > 1 else "','"
            within = f" WITHIN GROUP (ORDER BY {', '.join(f'{k} {'DESC' if d else 'ASC'}' for k, d in order)})" if order else ""
            return E(f"listagg({once}{fx.as_text(x)}, {sep}){within}{where}", "text")
        if name == "OBJECT_AGG":
            t = "text" if low[1].type == "null" else low[1].type
            return E(f"map_from_entries(collect_list(struct({fx.as_text(x)}, {low[1].sql})){where})", ("map", t))
        t = "text" if x.type == "null" else x.type
        value = x.sql if x.type != "null" else "CAST(NULL AS STRING)"
        gather = "collect_set" if extra["distinct"] else "collect_list"
        if not order:
            return E(f"transform({gather}(named_struct('x', {value})){where}, s_ -> s_.x)", ("array", t))
        fields = ", ".join([f"'k{i}', {k}" for i, (k, _) in enumerate(order)] + [f"'x', {value}"])
        steps = ""
        for i, (_, down) in enumerate(order):
            a, b = (f"b_.k{i}", f"a_.k{i}") if down else (f"a_.k{i}", f"b_.k{i}")
            steps += f" WHEN {a} IS NULL AND {b} IS NOT NULL THEN -1 WHEN {a} IS NOT NULL AND {b} IS NULL THEN 1 WHEN {a} < {b} THEN -1 WHEN {a} > {b} THEN 1"
        return E(f"transform(array_sort({gather}(named_struct({fields})){where}, (a_, b_) -> CASE{steps} ELSE 0 END), s_ -> s_.x)", ("array", t))


def of(sql: str) -> list[str]:
    """The aliases of sources that lowered text names; too many rather than too few."""
    return sorted(set(re.findall(r"\bq\d+_(?=\.)", sql)))


def unmoved(sql: str) -> bool:
    """Whether text holds a subquery or random values, which stay where they are."""
    return re.search(r"SELECT|\brand\(|\buuid\(", sql) is not None


def conjuncts(e) -> list:
    if e[0] == "group":
        return conjuncts(e[1])
    return conjuncts(e[1]) + conjuncts(e[2]) if e[0] == "and" else [e]


def unjoined(s: Select) -> Select:
    """A query of one inner join ON a predicate on periods, as one of two sources and a condition."""
    j = s.sources[0] if len(s.sources) == 1 else None
    if j is None or j.kind != "join" or j.how != "inner" or j.using or j.on is None or not any(e[0] == "func" and e[1] in fx.PERIODS for e in conjuncts(j.on)):
        return s
    return replace(s, sources=[j.left, j.right], where=j.on if s.where is None else ("and", j.on, s.where))


def strip(e):
    """An expression without source offsets and brackets."""
    if isinstance(e, list):
        return [strip(x) for x in e]
    if not isinstance(e, tuple):
        return e
    if e and e[0] == "name" and len(e) == 3:
        return ("name", e[1])
    if e and e[0] == "group" and len(e) == 2:
        return strip(e[1])
    return tuple(strip(x) for x in e)


def renamed(low: Lowered, names: list[str] | None) -> Lowered:
    if not names:
        return low
    if len(names) != len(low.columns):
        raise SqlError("Number of column names does not match projection")
    return Lowered(f"SELECT * FROM ({low.sql}) AS r_({', '.join(map(quote, unique([(n, None) for n in names])))})", [(n, t) for n, (_, t) in zip(names, low.columns, strict=True)])


def unique(columns: list) -> list[str]:
    """Names under which Spark can tell the columns apart."""
    out: list[str] = []
    for n, _ in columns:
        name, k = n, 1
        while name in out:
            k += 1
            name = f"{n}_{k}_"
        out.append(name)
    return out


def flat(sources: list) -> list:
    out = []
    for s in sources:
        out += flat([s.left, s.right]) if s.kind == "join" else [s]
    return out


def mentions(node, name: str) -> bool:
    """Whether a query reads the table ``name``."""
    if isinstance(node, Source):
        if node.kind == "table":
            return node.name == name
        return any(mentions(x, name) for x in (node.left, node.right, node.query, node.on, node.args) if x is not None)
    if isinstance(node, Query):
        return mentions(node.body, name) or any(mentions(c.query, name) for c in node.ctes)
    if isinstance(node, Select):
        return any(mentions(x, name) for x in (node.sources, [e for e, _ in node.items], node.where, node.having, node.group) if x is not None)
    if isinstance(node, (list, tuple)):
        return any(mentions(x, name) for x in node)
    return False
