"""Versioned tables in a folder: format probes, atomic replacement, one writer, unchanged tables not rewritten.

A table is a set of segments, folders seg=<n>; a pointer file _meta-<n>.json names those that count. A
new pointer appears by a rename onto a name that is not there yet, and the one with the greatest number
holds, so a reader sees either the old or the new state and a crash leaves the old one. The state
before is kept for readers that have begun; older segments and pointers go. All paths go through
Spark's file systems.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: under spark.checkpoint.dir; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "foliant-shared")
    return base.rstrip("/") + "/foliant-engine"


class Stale(RuntimeError):
    """Written in another format: build it anew."""


class Busy(RuntimeError):
    """Another writer holds the store."""


class Store:
    #: Seconds after which a lock counts as left behind by a writer that died.
    LOCK_SECONDS = 6 * 3600

    def __init__(self, spark: SparkSession, root: str, version: int = 1):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._fs(), self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _load(self, *parts: str) -> dict:
        stream = self._fs().open(self._path(*parts))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _pointers(self, table: str) -> list[str]:
        return [n for n in self._names(table) if n.startswith("_meta-")]

    def _point(self, table: str, data: dict) -> None:
        """Make `data` the state of a table, then sweep what only older states name."""
        fs, before = self._fs(), self._pointers(table)
        number = int(before[-1][6:-5]) + 1 if before else 0
        temp, path = self._path(table, f".{uuid.uuid4().hex}"), self._path(table, f"_meta-{number:09d}.json")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(data, sort_keys=True).encode()))
        out.close()
        if not fs.rename(temp, path):
            fs.delete(temp, False)
            raise Busy(self.root)
        for name in before[:-1]:
            fs.delete(self._path(table, name), False)
        named = {*data["segments"], *(self._load(table, before[-1])["segments"] if before else [])}
        for name in self._names(table):
            if name.startswith("seg=") and int(name[4:]) not in named:
                fs.delete(self._path(table, name), True)

    def meta(self, table: str) -> dict | None:
        """Of the current state; raises Stale for another format, before any data is read."""
        names = self._pointers(table)
        meta = self._load(table, names[-1]) if names else None
        if meta and meta["version"] != self.version:
            raise Stale(f"{table}: format {meta['version']}, expected {self.version}")
        return meta

    def _open(self, table: str, meta: dict, segments: list[int]) -> DataFrame:
        paths = [f"{self.root}/{table}/seg={n}" for n in segments]
        rows = self.spark.read.schema(meta["schema"] + ", seg int").option("basePath", f"{self.root}/{table}").parquet(*paths)
        return rows

    def read(self, table: str, segments: bool = False) -> DataFrame | None:
        """The rows; with `seg`, the number of their segment, if that is wanted."""
        meta = self.meta(table)
        if not meta:
            return None
        rows = self._open(table, meta, meta["segments"])
        return rows if segments else rows.drop("seg")

    def _segment(self, table: str, df: DataFrame, partition: tuple) -> int:
        number = time.time_ns() // 1000 % (1 << 31)
        while f"seg={number}" in self._names(table):
            number += 1
        df.write.partitionBy(*partition).parquet(f"{self.root}/{table}/seg={number}")
        return number

    def write(self, table: str, df: DataFrame, partition: tuple = (), **extra) -> bool:
        """Replace a table; false if the rows are the same as before and nothing was written."""
        old = self.meta(table) if self._pointers(table) and self._load(table, self._pointers(table)[-1])["version"] == self.version else None
        df = df.select(*[c for c in df.columns if c not in partition], *partition)
        number = self._segment(table, df, partition)
        schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
        meta = {"version": self.version, "schema": schema, "columns": df.columns, "extra": extra, "partition": list(partition)}
        digest = self.digest(self._open(table, meta, [number]).drop("seg"))
        if old and old["digest"] == digest and old["extra"] == extra and len(old["segments"]) == 1:
            self._fs().delete(self._path(table, f"seg={number}"), True)
            return False
        self._point(table, meta | {"digest": digest, "segments": [number]})
        return True

    def add(self, table: str, df: DataFrame, partition: tuple = (), **extra) -> int:
        """Add rows as a segment of their own; what is there stays as it is. Returns the segment's number."""
        old = self.meta(table)
        names = [c for c in df.columns if c not in partition] + list(partition)
        if old and sorted(old["columns"]) == sorted(names):
            names = old["columns"]
        df = df.select(*names)
        number = self._segment(table, df, partition)
        schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
        if old and old["schema"] != schema:
            raise Stale(f"{table}: columns {old['schema']}, not {schema}")
        self._point(table, {"version": self.version, "schema": schema, "columns": df.columns, "extra": extra, "partition": list(partition), "digest": None, "segments": [*(old["segments"] if old else []), number]})
        return number

    def drop(self, table: str) -> None:
        self._fs().delete(self._path(table), True)

    @staticmethod
    def digest(df: DataFrame) -> str:
        """Of the rows in any order."""
        h = F.xxhash64(F.to_json(F.struct(*df.columns)))
        row = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
        return f"{row['n']}:{row['s']}:{row['x']}:{df.schema.simpleString()}"

    def log(self, table: str, key: str = "key") -> DataFrame | None:
        """Rows of a table that grows by `add`: one of each key."""
        rows = self.read(table)
        return rows if rows is None else rows.dropDuplicates([key])

    def compact(self, table: str, live: DataFrame, key: str = "key", slack: int = 1024) -> bool:
        """Rewrite a log without dead keys once these are many and outnumber the live ones."""
        log = self.log(table, key)
        kept = log.join(live.select(key).distinct(), key, "left_semi")
        n, alive = log.count(), kept.count()
        if n - alive <= slack or n - alive <= alive:
            return False
        return self.write(table, kept)

    def lock(self):
        return _Lock(self)


class _Lock:
    def __init__(self, store: Store):
        self.store, self.path = store, store._path("_lock")

    def __enter__(self):
        fs = self.store._fs()
        if fs.createNewFile(self.path):
            return self
        age = time.time() - fs.getFileStatus(self.path).getModificationTime() / 1000
        if age > Store.LOCK_SECONDS and fs.delete(self.path, False) and fs.createNewFile(self.path):
            return self
        raise Busy(self.store.root)

    def __exit__(self, *_):
        self.store._fs().delete(self.path, False)


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """{"queries": [{"query", "expect", "group"}]} -> query_id, query, group, path; refuses empty sets and queries without expectations."""
    schema = "queries array<struct<query:string,expect:array<string>,group:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("queries").alias("query_id", "q"))
    n, bad = rows.agg(F.count("*"), F.count_if(F.coalesce(F.size("q.expect"), F.lit(0)) < 1)).first()
    if not n or bad:
        raise ValueError("an empty query set" if not n else f"{bad} queries expect nothing")
    return rows.select("query_id", "q.query", "q.group", F.explode("q.expect").alias("path"))
