"""A store of table versions: Parquet folders, and a log with a file for each commit, created only if it isn't there yet, so
that of two writers one fails. Readers trust logged versions alone. All paths go through Hadoop's file systems."""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rinsework.plans.provenance import content_hash


class Conflict(RuntimeError):
    """Another writer made this version first."""


class VersionStore:
    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.uri).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self, n: int) -> str:
        return f"{self.uri}/_log/{n:020d}.json"

    def exists(self) -> bool:
        return self._fs.exists(self._path(self._log(0)))

    def versions(self) -> list[int]:
        folder = self._path(f"{self.uri}/_log")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def current(self) -> int:
        return max(self.versions(), default=-1)

    def entry(self, n: int) -> dict[str, Any] | None:
        """None for an entry that its writer left unfinished: the number is taken, but there is no such version."""
        stream = self._fs.open(self._path(self._log(n)))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()
        return found if isinstance(found, dict) and "folder" in found else None

    def history(self) -> list[dict[str, Any]]:
        return [e for e in map(self.entry, reversed(self.versions())) if e]

    def labels(self) -> dict[str, int]:
        return {f"v{e['version']}: {e['operation']}": e["version"] for e in self.history()}

    def commit(self, df: DataFrame, operation: str, target: str = "ALL", **more: Any) -> int:
        n = self.current() + 1
        folder = f"{self.uri}/v={n}-{time.time_ns():x}"
        df.write.parquet(folder)
        written = self.spark.read.schema(df.schema).parquet(folder)
        entry = {"version": n, "parent": n - 1, "operation": operation, "target": target, "rows": written.count(), "columns": df.columns, "schema": json.loads(df.schema.json()), "content_hash": content_hash(written), "folder": folder, "timestamp": time.time(), **more}
        try:
            stream = self._fs.create(self._path(self._log(n)), False)
        except Exception as e:  # py4j wraps the file system's error
            raise Conflict(f"version {n} exists already") from e
        stream.write(bytearray(json.dumps(entry, default=str).encode()))
        stream.close()
        return n

    def read(self, n: int | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        known = self.versions()
        numbers = reversed(known) if n is None else [n] if n in known else []
        e = next(filter(None, map(self.entry, numbers)), None)
        if e is None:
            raise KeyError(f"no version {'at all' if n is None else n}")
        return self.spark.read.schema(StructType.fromJson(e["schema"])).parquet(e["folder"])

    def restore(self, n: int) -> int:
        """A new version with the content of an old one."""
        return self.commit(self.read(n), f"restore of version {n}", restored=n)
