"""Moves between tables that happen wholly or not at all.

A set of tables lives under one folder as Parquet parts and a chain of manifests. A manifest
names the parts of every table, and the operations that led to it. A move first writes
the new parts, each to a folder of its own, then publishes them all by one rename of a
manifest. Whatever stops between those writes leaves the tables as they were: parts that no
manifest names are never read. The same operation committed again changes nothing, so a
caller that does not know whether it got through repeats it.

Publishing needs a file system whose rename fails if the target is there (HDFS, local);
of two writers at once one gets a ``Conflict`` and begins again from the tables as they are then.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from newsloom.operators import queue as q


class Conflict(RuntimeError):
    """Another writer published first."""


@dataclass(frozen=True)
class Append:
    """Rows that a table gains; its other parts stay as they are."""

    rows: DataFrame


@dataclass(frozen=True)
class Replace:
    """All rows that a table has from now on."""

    rows: DataFrame


class Tables:
    """The tables under a folder, as the last manifest has them."""

    #: Operations of which a manifest remembers the names; a repetition later than that is new.
    REMEMBERED = 10_000

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def version(self) -> int:
        """The number of the last manifest; 0 before the first."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "operations": []}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version:012}.json", wholetext=True).first()[0])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as a manifest has it."""
        table = self.manifest(version)["tables"][name]
        return self.spark.read.schema(StructType.fromJson(table["schema"])).parquet(*(f"{self.root}/{p}" for p in table["parts"]))

    def commit(self, operation: str, changes: dict[str, Append | Replace], since: int | None = None) -> bool:
        """Publish changes of several tables at once; False if an operation of that name is in already.

        ``since`` is the version that the changes were made from.
        """
        since = self.version() if since is None else since
        now = self.manifest(since)
        if operation in self.manifest()["operations"]:
            return False
        tables = dict(now["tables"])
        for name, change in changes.items():
            part = f"{name}/{uuid.uuid4().hex}"
            change.rows.write.parquet(f"{self.root}/{part}")
            before = tables.get(name, {"parts": []})["parts"] if isinstance(change, Append) else []
            tables[name] = {"parts": [*before, part], "schema": tables[name]["schema"] if before else change.rows.schema.jsonValue()}
        self._publish(since + 1, {"tables": tables, "operations": [*now["operations"], operation][-self.REMEMBERED :]})
        return True

    def _publish(self, version: int, manifest: dict) -> None:
        draft = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self._path(f"{self.root}/manifests/{version:012}.json")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} was published by another writer")

    def unused(self) -> list[str]:
        """Parts that no manifest names: what stopped moves have left. Nothing reads them; delete those of some age."""
        used = {p for v in range(1, self.version() + 1) for t in self.manifest(v)["tables"].values() for p in t["parts"]}
        found = []
        for table in self._fs.listStatus(self._path(self.root)):
            if table.isDirectory() and table.getPath().getName() != "manifests":
                found += [f"{table.getPath().getName()}/{p.getPath().getName()}" for p in self._fs.listStatus(table.getPath())]
        return sorted(set(found) - used)


def _new(after: DataFrame, before: DataFrame) -> Append:
    """The rows that a ledger gained."""
    return Append(after.join(before.select("link"), "link", "left_anti").select(*before.columns))


def publish(tables: Tables, operation: str, done: DataFrame, now: Column) -> bool:
    """Move the links of ``done`` from pending to published, and remember them as processed."""
    at = tables.version()
    pending, published, processed = (tables.read(n, at) for n in ("pending", "published", "processed"))
    left, out, seen = q.move_to_published(pending, published, processed, done, now)
    return tables.commit(operation, {"published": _new(out, published), "processed": _new(seen, processed), "pending": Replace(left)}, at)


def fail(tables: Tables, operation: str, errors: DataFrame, now: Column) -> bool:
    """Move the links of ``errors`` from pending to failed."""
    at = tables.version()
    left, failed = q.move_to_failed(tables.read("pending", at), tables.read("failed", at), errors, now)
    return tables.commit(operation, {"failed": Replace(failed), "pending": Replace(left)}, at)


def retry(tables: Tables, operation: str, links: DataFrame, now: Column) -> bool:
    """Queue failed links again."""
    at = tables.version()
    pending = tables.read("pending", at)
    failed, out = q.retry_failed(tables.read("failed", at), pending, links, now)
    return tables.commit(operation, {"pending": _new(out, pending), "failed": Replace(failed)}, at)


def skip(tables: Tables, operation: str, links: DataFrame, now: Column) -> bool:
    """Retire pending links unpublished, and remember them as processed."""
    at = tables.version()
    processed = tables.read("processed", at)
    left, seen = q.skip_pending(tables.read("pending", at), processed, links, now)
    return tables.commit(operation, {"processed": _new(seen, processed), "pending": Replace(left)}, at)
