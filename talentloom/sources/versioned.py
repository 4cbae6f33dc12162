"""A keyed table in versions: immutable data folders, one manifest a version, commits that fail where another writer was first.

A version is a manifest file with the name of its data folder. A writer puts its data beside the others', then creates the next manifest, which the
file system lets only one writer do. The loser reads the newer version and merges again. Readers take the newest whole manifest, so they
see one version or the other, never parts of two. Works on file systems that create a file only where there is none (local, HDFS and object
stores with such a guarantee).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.operators.resolve import upsert


class Conflict(Exception):
    """Another writer committed this version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions in order."""
        folder = self._path("manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and self._manifest(int(n.removesuffix(".json"))) is not None)

    def _manifest(self, version: int) -> dict | None:
        """A version's manifest, or None while it is still being written."""
        rows = self.spark.read.text(f"{self.path}/manifest/{version:012d}.json").collect()
        try:
            return json.loads("".join(r[0] for r in rows)) if rows else None
        except ValueError:
            return None

    def latest(self) -> int:
        return max(self.versions(), default=-1)

    def read(self, version: int | None = None) -> DataFrame:
        """One whole version, the newest by default; an empty table before the first."""
        version = self.latest() if version is None else version
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        manifest = self._manifest(version)
        if manifest is None:
            raise ValueError(f"no version {version}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{manifest['data']}")

    def commit(self, rows: DataFrame, parent: int, note: dict | None = None) -> int:
        """Write rows as the version after parent; Conflict where that version is taken."""
        data = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{data}")
        text = json.dumps({"version": parent + 1, "data": data} | (note or {}))
        name = self._path(f"manifest/{parent + 1:012d}.json")
        try:
            out = self._fs.create(name, False)  # fails where the file is there
        except Exception as e:
            if self._fs.exists(name):
                self._fs.delete(self._path(f"data/{data}"), True)
                raise Conflict(str(parent + 1)) from e
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return parent + 1

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
        """Commit change(newest version), again on the newer version where another writer was first."""
        for left in range(tries - 1, -1, -1):
            parent = self.latest()
            try:
                return self.commit(change(self.read(parent)), parent)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def upsert(self, new: DataFrame, key: str, now: Column) -> int:
        """Merge new rows by key: created_at stays, updated_at tells the last write; one row a key is needed."""
        if new.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            raise ValueError(f"repeated {key} in one upsert")
        return self.update(lambda old: upsert(old, new, key, now).drop("action"))
