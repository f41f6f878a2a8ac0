"""Versioned tables: Parquet batches, logs of ended and erased rows, and a manifest per transaction.

A row keeps the identity (_batch, _row) and its start time for good; an update ends a row and appends another. A
manifest is one JSON file named by its transaction number and linked to that name exclusively, so of two writers one
wins and the other sees a conflict. Readers take the last whole manifest, a snapshot of file lists. Erased rows leave
the files by compaction and vacuum.
"""

from __future__ import annotations

import copy
import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scalar as fx
from palimpsest.plans.types import E, ddl, quote, unify

END = "TIMESTAMP'9999-01-01 00:00:00'"


class Conflict(Exception):
    """Another writer has published the transaction first."""


def pack_type(t):
    return t if isinstance(t, str) else [t[0], [[k, pack_type(x)] for k, x in t[1]]] if t[0] == "object" else [t[0], pack_type(t[1])]


def unpack_type(t):
    return t if isinstance(t, str) else ("object", tuple((k, unpack_type(x)) for k, x in t[1])) if t[0] == "object" else (t[0], unpack_type(t[1]))


class Store:
    """The files of a database under ``root``, in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.io = jvm.org.apache.commons.io.IOUtils
        self.fs.mkdirs(self.Path(f"{self.root}/manifest"))

    def numbers(self) -> list[int]:
        found = self.fs.listStatus(self.Path(f"{self.root}/manifest"))
        return sorted(int(s.getPath().getName()[:-5]) for s in found if s.getPath().getName().endswith(".json"))

    def read(self, path) -> dict | None:
        """A manifest; None if the file is damaged."""
        stream = self.fs.open(path)
        try:
            body = self.io.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(body) if body.endswith("\n") else None
        except ValueError:
            return None

    def place(self, number: int):
        return self.Path(f"{self.root}/manifest/{number:012d}.json")

    def latest(self) -> dict:
        for n in reversed(self.numbers()):
            if (found := self.read(self.place(n))) is not None:
                return found
        return {"tx": 0, "at": "1970-01-01T00:00:00", "tables": {}, "views": {}, "assertions": {}}

    def link(self, written, path) -> None:
        """Give a complete file its final name, or fail if there is one of that name: atomic in local folders and in HDFS."""
        jvm = self.spark.sparkContext._jvm
        if self.fs.getScheme() == "file":
            jvm.java.nio.file.Files.createLink(*(jvm.java.nio.file.Paths.get(x.toUri().getPath(), self.none(jvm.java.lang.String)) for x in (path, written)))
            self.fs.delete(written, False)
        else:
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            options = self.spark.sparkContext._gateway.new_array(rename, 1)
            options[0] = rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri()).rename(written, path, options)

    def none(self, kind):
        return self.spark.sparkContext._gateway.new_array(kind, 0)

    def publish(self, manifest: dict, now: dt.datetime) -> None:
        """Make ``manifest`` the next transaction, or raise Conflict.

        It is written under a name of its own and then linked, so a writer that dies leaves no part of a manifest. A
        damaged file in the way is put aside.
        """
        manifest["tx"] += 1
        manifest["at"] = now.isoformat()
        path, written = self.place(manifest["tx"]), self.Path(f"{self.root}/manifest/{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(written, False)
        try:
            stream.write(bytearray((json.dumps(manifest) + "\n").encode()))
        finally:
            stream.close()
        try:
            if self.fs.exists(path) and self.read(path) is None:
                aside = self.Path(f"{self.root}/manifest/{uuid.uuid4().hex}.damaged")
                self.fs.rename(path, aside)
                if self.read(aside) is not None:  # another writer has mended it in between
                    self.link(aside, path)
            self.link(written, path)
        except Exception as err:
            self.fs.delete(written, False)
            if self.fs.exists(path):
                raise Conflict(f"Conflict at transaction {manifest['tx']}") from err
            raise

    def vacuum(self, before: dt.datetime) -> int:
        """Delete manifests published before that time but for the newest, and all files that no manifest left names; the number of deletions.

        Files younger than that stay, as a transaction that is still open may have written them.
        """
        kept, gone = [], 0
        numbers = self.numbers()
        for n in numbers:
            found = self.read(self.place(n))
            if n != numbers[-1] and (found is None or dt.datetime.fromisoformat(found["at"]).replace(tzinfo=dt.timezone.utc) < before):
                gone += bool(self.fs.delete(self.place(n), False))
            elif found is not None:
                kept.append(found)
        named = {p.rpartition("/")[2] for m in kept for meta in m["tables"].values() for p in [*(b["path"] for b in meta["batches"]), *meta["ended"], *meta["erased"]]}
        for kind in ("data", "ended", "erased"):
            folder = self.Path(f"{self.root}/{kind}")
            for f in self.fs.listStatus(folder) if self.fs.exists(folder) else ():
                if f.getPath().getName() not in named and f.getModificationTime() < before.timestamp() * 1000:
                    gone += bool(self.fs.delete(f.getPath(), True))
        return gone

    def written(self, rows: DataFrame, path: str) -> int:
        """Write a batch; its number of rows, counted by the writing tasks themselves."""
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return seen.get["n"]

    def append(self, manifest: dict, table: str, df: DataFrame, columns: list[tuple[str, object]], now: dt.datetime) -> int:
        """Write rows as a new batch; the number of rows."""
        batch = uuid.uuid4().hex
        path = f"{self.root}/data/{batch}"
        stored = [(n, t) for n, t in columns if t != "null"]
        out = df.select(*(F.expr(quote(n)).alias(n) for n, _ in stored), F.lit(batch).alias("_batch"), F.monotonically_increasing_id().alias("_row"), F.expr(fx.literal(now).sql).alias("_start"))
        rows = self.written(out, path)
        meta = manifest["tables"].setdefault(table, {"batches": [], "ended": [], "erased": [], "columns": {}, "created": False})
        for n, _ in columns:
            meta["columns"].setdefault(n, 0)
        if rows:
            meta["batches"].append({"path": path, "rows": rows, "columns": {n: pack_type(t) for n, t in columns}})
        return rows

    def log(self, manifest: dict, table: str, rows: DataFrame, kind: str, now: dt.datetime) -> int:
        """Record (_batch, _row) as ended or erased; the number of rows."""
        path = f"{self.root}/{kind}/{uuid.uuid4().hex}"
        n = self.written(rows.select("_batch", "_row", F.expr(fx.literal(now).sql).alias("_end")), path)
        if n:
            manifest["tables"][table][kind].append(path)
        return n

    def columns_of(self, meta: dict) -> list[tuple[str, object]]:
        """By declared place, then name; types as wide as all batches need."""
        types: dict = dict.fromkeys(meta["columns"], "null")
        for b in meta["batches"]:
            for n, t in b["columns"].items():
                types[n] = unify(types[n], unpack_type(t))
        return [(n, types[n]) for n in sorted(types, key=lambda n: (meta["columns"][n], n))]

    def scan(self, meta: dict, period: tuple | None) -> DataFrame | None:
        """Rows with _batch, _row, _start, _end: those that hold now, or that meet ``period`` of system time.

        Batches of the same schema are one scan. Ended and erased rows are taken out by an anti join, or give _end by a
        left join for past times; Catalyst picks its kind by the logs' size. Without logs there is no join.
        """
        columns = self.columns_of(meta)
        groups: dict[str, list] = {}
        for b in meta["batches"]:
            groups.setdefault(json.dumps(b["columns"], sort_keys=True), []).append(b)
        out = None
        for batches in groups.values():
            own = {n: unpack_type(t) for n, t in batches[0]["columns"].items()}
            df = self.spark.read.parquet(*(b["path"] for b in batches))
            cells = []
            for n, t in columns:
                have = own.get(n, "null")
                sql = fx.null_of(t) if have == "null" else fx.cast_to(E(quote(n), have), t)
                cells.append(f"{sql if sql != 'NULL' else 'CAST(NULL AS STRING)'} AS {quote(n)}")
            df = df.selectExpr(*cells, "_batch", "_row", "_start")
            out = df if out is None else out.unionByName(df)
        if out is None:
            return None
        if meta["erased"]:
            out = out.join(self.spark.read.parquet(*meta["erased"]).select("_batch", "_row"), ["_batch", "_row"], "left_anti")
        if not meta["ended"]:
            out = out.withColumn("_end", F.expr(END))
        elif period is None:
            ended = self.spark.read.parquet(*meta["ended"]).select("_batch", "_row")
            out = out.join(ended, ["_batch", "_row"], "left_anti").withColumn("_end", F.expr(END))
        else:
            ended = self.spark.read.parquet(*meta["ended"]).groupBy("_batch", "_row").agg(F.min("_end").alias("_end"))
            out = out.join(ended, ["_batch", "_row"], "left").withColumn("_end", F.coalesce("_end", F.expr(END)))
        if period:
            kind, *times = period
            times = [f"CAST({t} AS TIMESTAMP)" for t in times]
            test = {"as_of": "_start <= {0} AND _end > {0}", "between": "_start <= {1} AND _end > {0}", "from": "_start < {1} AND _end > {0}", "all": "true"}[kind]
            out = out.where(test.format(*times))
        return out.select(*(quote(n) for n, _ in columns), "_batch", "_row", "_start", "_end")

    def compact(self, manifest: dict, table: str) -> dict:
        """A manifest in which the table is one batch without erased rows; identities and history stay."""
        manifest = copy.deepcopy(manifest)
        meta = manifest["tables"][table]
        rows = self.scan(meta, ("all",))
        if rows is None:
            return manifest
        columns = self.columns_of(meta)
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        stored = [n for n, t in columns if t != "null"]
        n = self.written(rows.select(*(quote(n) for n in stored), "_batch", "_row", "_start"), path)
        meta["batches"] = [{"path": path, "rows": n, "columns": {c: pack_type(t) for c, t in columns}}] if n else []
        meta["erased"] = []
        return manifest


def empty(spark: SparkSession, columns: list[tuple[str, object]]) -> DataFrame:
    """No rows, with the columns of a scan."""
    fields = [f"{quote(n)} {ddl(t) if t != 'null' else 'string'}" for n, t in columns]
    return spark.createDataFrame([], ", ".join([*fields, "_batch string", "_row long", "_start timestamp", "_end timestamp"]))
