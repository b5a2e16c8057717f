"""Versions of a folder of tables: a manifest names the folders that are valid, one rename switches to the next.

A writer puts rows into new folders, which nobody reads yet, and commits a manifest that
names them; a reader takes the newest manifest and reads its folders only. So a reader sees
the tables as one version, whatever is being written or has failed half-way. Folders that
only older manifests name are removed by `vacuum`. One writer at a time is assumed.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Snapshots:
    """The versions under `root`, a folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._path("manifests")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def children(self, folder: str) -> list[str]:
        """Names in a folder under the root."""
        path, fs = self._path(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version:012d}.json", wholetext=True).first()[0])

    def read(self) -> dict:
        """The newest manifest; an empty one before the first commit."""
        known = self.versions()
        return self._read(known[-1]) if known else {"tables": {}}

    def commit(self, manifest: dict) -> int:
        """Makes `manifest` the newest one: {"tables": {name: [folders under the root]}, anything else}."""
        known = self.versions()
        version = known[-1] + 1 if known else 0
        temp, fs = self._path(f"manifests/.{uuid.uuid4().hex}")
        final, _ = self._path(f"manifests/{version:012d}.json")
        out = fs.create(temp)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temp, final):
            raise RuntimeError(f"another writer committed version {version} of {self.root}")
        return version

    def table(self, name: str, manifest: dict | None = None, schema: T.StructType | str | None = None) -> DataFrame:
        """The rows of a table in its valid folders. Folders named key=value give that column."""
        folders = (manifest or self.read())["tables"].get(name, [])
        if not folders:
            if schema is None:
                raise ValueError(f"no version of {self.root} holds a table {name}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", f"{self.root}/{name}")
        reader = reader if schema is None else reader.schema(schema)
        return reader.parquet(*[f"{self.root}/{f}" for f in folders])

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes all but the newest `keep` manifests, and the folders that only the removed ones name."""
        known = self.versions()
        old, new = known[:-keep], known[-keep:]
        if not old:
            return []
        named = lambda vs: {f for v in vs for fs in self._read(v)["tables"].values() for f in fs}
        gone = sorted(named(old) - named(new))
        for name in gone + [f"manifests/{v:012d}.json" for v in old]:
            path, fs = self._path(name)
            fs.delete(path, True)
        return gone
