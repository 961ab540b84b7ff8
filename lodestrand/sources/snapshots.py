"""Keyed tables with snapshots, on any file system that Spark reads.

A table is a folder. Rows lie in buckets by a hash of their key. A snapshot is
one small file that names the folder of each bucket and is never changed; the
one with the highest number is the table. A write puts new folders beside the
old ones for the buckets that it touches, and then moves the next snapshot's
file into place, which fails if another writer was first. So a reader sees a
whole snapshot, whatever is written meanwhile, and an older one can be read
until vacuum() takes it away.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import keep_latest


class ChangedMeanwhile(RuntimeError):
    """Another writer has made the snapshot that this one was about to make."""


class SnapshotTable:
    """The table at a path. keys and buckets are kept from its first write on, so that only that needs them."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        self._fs, self._jvm, self._conf = self._path().getFileSystem(conf), jvm, conf
        self.keys = self.snapshot().get("keys") or keys
        if not self.keys:
            raise ValueError("a new table needs keys")

    # snapshots
    def versions(self) -> list[int]:
        """The numbers of all snapshots, in order."""
        at = self._path("snapshots")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def snapshot(self, version: int | None = None) -> dict:
        """A snapshot: version, schema, keys, buckets (how many), folders (of each bucket that has rows). Version 0 is the empty table."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "keys": None, "buckets": self.buckets, "folders": {}}
        stream = self._fs.open(self._path("snapshots", f"{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, old: dict, schema: T.StructType, folders: dict[str, str]) -> int:
        new = {"version": old["version"] + 1, "schema": schema.jsonValue(), "keys": self.keys, "buckets": old["buckets"], "folders": folders}
        side = self._path("snapshots", f"_{uuid.uuid4().hex}")
        out = self._fs.create(side, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        fs = self._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
        try:  # fails if there is such a file
            fs.FileContext.getFileContext(side.toUri() if side.toUri().getScheme() else self._fs.getUri(), self._conf).rename(side, self._path("snapshots", f"{new['version']:012d}.json"), none)
        except Exception as e:
            self._fs.delete(side, False)
            if "AlreadyExists" in str(e):
                raise ChangedMeanwhile(f"{self.path} has a snapshot {new['version']} already") from None
            raise
        return new["version"]

    # reading
    def _rows(self, snap: dict, buckets=None) -> DataFrame:
        schema = T.StructType.fromJson(snap["schema"])
        folders = [f for b, f in snap["folders"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a snapshot, the latest by default. A table that was never written has no columns to show: an error."""
        snap = self.snapshot(version)
        if snap["schema"] is None:
            raise ValueError(f"{self.path} has no snapshot yet")
        return self._rows(snap)

    # writing
    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(n)).cast("int").alias("_bucket")

    def _write(self, rows: DataFrame, n: int) -> dict[str, str]:
        """Writes rows by bucket, each a task's files; the folder of every bucket that got any."""
        name = f"data/{uuid.uuid4().hex}"
        rows.select("*", self._bucket(n)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        made = [f.getPath().getName() for f in self._fs.listStatus(self._path(name)) if f.isDirectory()]
        return {m.removeprefix("_bucket="): f"{name}/{m}" for m in made if m.startswith("_bucket=")}

    def upsert(self, new: DataFrame, order: list | None = None) -> int:
        """Rows of new replace those of their key, of several the first by `order`; only buckets with such keys are rewritten. Returns the snapshot's number."""
        snap = self.snapshot()
        if snap["schema"] is None:
            return self._commit(snap, new.schema, self._write(keep_latest(new.limit(0), new, self.keys, order), snap["buckets"]))
        touched = {r[0] for r in new.select(self._bucket(snap["buckets"])).distinct().collect()}
        merged = keep_latest(self._rows(snap, touched), new, self.keys, order)
        kept = {b: f for b, f in snap["folders"].items() if int(b) not in touched}
        return self._commit(snap, merged.schema if set(merged.columns) != set(T.StructType.fromJson(snap["schema"]).names) else T.StructType.fromJson(snap["schema"]), kept | self._write(merged, snap["buckets"]))

    def delete(self, condition) -> int:
        """K6: the table without the rows for which the condition is true; only buckets that have such rows are rewritten."""
        snap = self.snapshot()
        rows = self._rows(snap)
        touched = {r[0] for r in rows.where(condition).select(self._bucket(snap["buckets"])).distinct().collect()}
        kept = {b: f for b, f in snap["folders"].items() if int(b) not in touched}
        left = self._rows(snap, touched).where(~F.coalesce(condition, F.lit(False)))
        return self._commit(snap, rows.schema, kept | (self._write(left, snap["buckets"]) if touched else {}))

    def replace(self, rows: DataFrame) -> int:
        """K8: all rows anew."""
        snap = self.snapshot()
        return self._commit(snap, rows.schema, self._write(rows, snap["buckets"]))

    def vacuum(self, keep: int = 1) -> None:
        """Takes away all but the last `keep` snapshots, and the folders that only older ones name. Readers of those fail from then on."""
        versions = self.versions()
        used = {f for v in versions[-keep:] for f in self.snapshot(v)["folders"].values()}
        for v in versions[:-keep]:
            for f in set(self.snapshot(v)["folders"].values()) - used:
                self._fs.delete(self._path(f), True)
            self._fs.delete(self._path("snapshots", f"{v:012d}.json"), False)
