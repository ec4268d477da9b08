"""A stored table that batches change: only the buckets that a batch touches are written, and a new version appears at once.

A version is a list of folders, one for each bucket of the key, and is named by a small manifest. A batch reads the buckets that its keys
fall in, combines them with its rows, writes them to new folders, and puts the manifest of the next version in place by a rename,
which either happens or doesn't. Readers hold the version that they opened. What a lost job wrote without a manifest is never
read, and a batch that is run again after its manifest was put in place changes nothing.

One writer works at a time; a second one finds its version taken, and raises.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a table; a batch collects the numbers of those that it touches.
BUCKETS = 64


class StoredTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._paths(f"{self.path}/manifests")
        found = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(name) for name in found if name.isdecimal())

    def _manifest(self, version: int) -> dict:
        rows = self.spark.read.text(f"{self.path}/manifests/{version}").collect()  # one line
        return json.loads(rows[0]["value"])

    def current(self) -> dict:
        """The newest manifest: version, folders by bucket, and the last batch of each source."""
        versions = self._versions()
        return self._manifest(versions[-1]) if versions else {"version": 0, "folders": {}, "batches": {}}

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the newest if none is named."""
        return self._read(list((self.current() if version is None else self._manifest(version))["folders"].values()))

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _put(self, manifest: dict) -> None:
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(draft)
        self._files.mkdirs(self._paths(f"{self.path}/manifests"))
        place = self._paths(f"{self.path}/manifests/{manifest['version']}")
        # a rename onto a folder would move the draft into it, so a taken place is looked for first
        if self._files.exists(place) or not self._files.rename(self._paths(draft), place):
            raise RuntimeError(f"version {manifest['version']} of {self.path} was written by another job")

    def merge(self, batch: int, rows: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], source: str = "", before_switch: Callable[[], None] = lambda: None) -> int:
        """The version after a batch of a source, whose batches are numbered upwards. combine(stored rows, new rows) gives the rows of
        the buckets that the new ones fall in; it gets whole buckets, and keeps the keys of others apart by itself."""
        manifest = self.current()
        if batch <= manifest["batches"].get(source, -1):
            return manifest["version"]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = sorted(r["b"] for r in rows.select(bucket.alias("b")).distinct().collect())
        old = self._read([manifest["folders"][str(b)] for b in touched if str(b) in manifest["folders"]])
        folder = f"{self.path}/rows/{uuid.uuid4().hex}"
        merged = combine(old, rows).select(*self.schema.names).withColumn("_bucket", bucket)
        merged.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(folder)
        there = {f.getPath().getName() for f in self._files.listStatus(self._paths(folder))}
        folders = {b: f for b, f in manifest["folders"].items() if int(b) not in set(touched)}
        folders |= {str(b): f"{folder}/_bucket={b}" for b in touched if f"_bucket={b}" in there}
        before_switch()
        self._put({"version": manifest["version"] + 1, "folders": folders, "batches": manifest["batches"] | {source: batch}})
        return manifest["version"] + 1

    def drop_versions(self, keep: int = 2) -> None:
        """Deletes what only versions older than the newest ones name. Readers of these must have ended."""
        versions = self._versions()
        kept = {f for v in versions[-keep:] for f in self._manifest(v)["folders"].values()}
        gone = {f for v in versions[:-keep] for f in self._manifest(v)["folders"].values()} - kept
        for f in [*gone, *(f"{self.path}/manifests/{v}" for v in versions[:-keep])]:
            self._files.delete(self._paths(f), True)
