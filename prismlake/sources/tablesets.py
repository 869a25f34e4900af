"""Several tables as one: all that belongs to a commit becomes visible together, or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class ConflictError(RuntimeError):
    """Another writer has committed since the snapshot that a commit is based on."""


@dataclass(frozen=True)
class Snapshot:
    """One version of a table set. What it reads stays the same whatever is committed later, until it is collected."""

    spark: SparkSession
    root: str
    version: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def table(self, name: str) -> DataFrame:
        t = self.tables[name]
        return self.spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{self.root}/data/{t['folder']}")


class TableSet:
    """Tables below a folder of any file system that Spark writes to.

    Each commit writes new folders for the tables that it changes, then a manifest that names the folders of all tables. The manifest is
    written beside its place and renamed to `<version>.json` unless that exists. That rename is the commit: a
    crash before it leaves the old version and folders that nobody names, a crash after it the new version. A commit says
    which snapshot it is based on, and fails if that isn't the latest any more.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict:
        return json.loads("\n".join(r["value"] for r in self.spark.read.option("wholetext", True).text(f"{self.root}/manifests/{version:09d}.json").collect()))

    def latest(self) -> Snapshot:
        """The last committed version; version 0 has no tables."""
        found = self.versions()
        return self.at(found[-1]) if found else Snapshot(self.spark, self.root)

    def at(self, version: int) -> Snapshot:
        m = self._manifest(version)
        return Snapshot(self.spark, self.root, version, m["tables"], m["notes"])

    def commit(self, base: Snapshot, changed: dict[str, DataFrame], removed: tuple[str, ...] = (), notes: dict | Callable[[Snapshot], dict] | None = None, options: dict[str, str] | None = None) -> Snapshot:
        """Write changed tables and make them, all others of base but the removed ones, and the notes the next version.

        Changed tables may read from base. Notes may be told from the written tables, by a function that takes the new version before it is
        visible. `options` go to the Parquet writer. Raises ConflictError if base isn't the latest version, before anything is written or, where another
        writer is faster, after it; what was written then goes.
        """
        if self.versions()[-1:] not in ([base.version], [] if base.version == 0 else None):
            raise ConflictError(f"version {base.version} isn't the latest")
        version, run, tables = base.version + 1, uuid.uuid4().hex, {n: t for n, t in base.tables.items() if n not in removed}
        for name, df in changed.items():
            folder = f"{name}/{version:09d}-{run}"
            df.write.options(**(options or {})).parquet(f"{self.root}/data/{folder}")
            tables[name] = {"folder": folder, "schema": df.schema.jsonValue()}
        more = notes(Snapshot(self.spark, self.root, version, tables, base.notes)) if callable(notes) else notes or {}
        manifest = {"tables": tables, "notes": {**base.notes, **more}}
        if not self._publish(version, run, json.dumps(manifest)):
            for name in changed:
                self._fs.delete(self._path(f"data/{tables[name]['folder']}"), True)
            raise ConflictError(f"version {version} was committed by another writer")
        return Snapshot(self.spark, self.root, version, tables, manifest["notes"])

    def _publish(self, version: int, run: str, text: str) -> bool:
        """Put a manifest in its place unless there is one; whether it was put."""
        beside, place = self._path(f"manifests/.{version:09d}-{run}"), self._path(f"manifests/{version:09d}.json")
        self._fs.mkdirs(self._path("manifests"))
        out = self._fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            # this rename fails where the target exists, unlike that of some file systems themselves
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(beside, place, options)
        except Exception:  # a Py4J error: the place is taken, or the rename failed
            self._fs.delete(beside, False)
            if version in self.versions():
                return False
            raise
        return True

    def collect(self, keep: int = 2) -> list[str]:
        """Delete what the last `keep` versions don't name: older manifests, and folders of them or of commits that never came to be.

        Folders of the version after the latest are left alone, since a writer may be at it.
        """
        found = self.versions()
        kept = found[-keep:]
        named = {t["folder"] for v in kept for t in self._manifest(v)["tables"].values()}
        gone = []
        for v in found[:-keep] if keep else []:
            self._fs.delete(self._path(f"manifests/{v:09d}.json"), False)
        for name in self._names("data"):
            for run in self._names(f"data/{name}"):
                if f"{name}/{run}" not in named and int(run.split("-")[0]) <= (found[-1] if found else 0):
                    self._fs.delete(self._path(f"data/{name}/{run}"), True)
                    gone.append(f"{name}/{run}")
        return gone

    def drop(self) -> None:
        """Delete the whole set."""
        self._fs.delete(self._path(""), True)
