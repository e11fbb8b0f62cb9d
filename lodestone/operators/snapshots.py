"""A copy-on-write table: rows in key buckets, snapshots as manifests, only touched buckets are rewritten.

A bucket of a snapshot is a folder ``data/s=<snapshot>/bucket=<b>``; a manifest names, for
every bucket, the snapshot that wrote it last. A change reads and writes the buckets of its
keys and names the others as they are, so unchanged rows are neither read nor copied, and
any kept snapshot can be read. The manifest is written last and never over another one: a
run that dies leaves folders that no manifest names. Two writers of one table are not
ordered; the second to commit the same snapshot fails.

The bucket is an expression of the key. Keys that change together should share buckets:
ranges of an id, or a hash of a path. The manifest has a row a bucket, a bounded number.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import children, delete, get, put


@dataclass
class SnapshotTable:
    """A table under `path`: its key columns, the bucket of a row (an int of the key alone), and how many snapshots stay readable."""

    spark: SparkSession
    path: str
    keys: list[str]
    bucket: Column
    keep: int = 3

    def versions(self) -> list[int]:
        """Snapshots that can be read, oldest first."""
        return sorted(int(n.removesuffix(".json")) for n in children(self.spark, f"{self.path}/manifests") if n.endswith(".json") and n[0].isdigit())

    def _manifest(self, version: int | None) -> dict:
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"no snapshot {version} in {self.path}; there are {known}")
        if not known:
            return {"version": 0, "buckets": {}, "schema": None}
        return json.loads(get(self.spark, f"{self.path}/manifests/{version or known[-1]}.json"))

    def _rows(self, manifest: dict, buckets=None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/data/s={s}/bucket={b}" for b, s in sorted(manifest["buckets"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a snapshot, the last one by default."""
        manifest = self._manifest(version)
        if manifest["schema"] is None:
            raise ValueError(f"{self.path} holds no snapshot")
        return self._rows(manifest)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__bucket", F.coalesce(self.bucket.cast("int"), F.lit(-1)))

    def change(self, rows: DataFrame | None = None, gone: DataFrame | None = None, version: int | None = None) -> int:
        """One snapshot further: rows replace those of their keys, or are new; keys of `gone` that rows do not bring again go.

        Returns the snapshot's number, the next one unless given. Of several rows of a key in
        `rows` all stay: the key is replaced as a whole, as the chunks of a file are. Null
        keys are equal to each other. Without any change the new snapshot names the old folders.
        """
        before = self._manifest(None)
        now = version or before["version"] + 1
        if now <= before["version"]:
            raise ValueError(f"snapshot {now} would not follow {before['version']}")
        if rows is None and before["schema"] is None:
            return before["version"]
        parts = [df.select(*self.keys) for df in (rows, gone) if df is not None]
        asked = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
        asked = self._bucketed(asked.distinct())
        touched = {r[0] for r in asked.select("__bucket").distinct().collect()}  # bucket numbers
        schema = rows.schema if rows is not None else T.StructType.fromJson(before["schema"])
        folder = f"{self.path}/data/s={now}"
        delete(self.spark, folder)  # of a run that died
        new = rows
        if before["buckets"]:
            old = self._rows(before, touched)
            matches = [old[k].eqNullSafe(asked[k]) for k in self.keys]
            kept = old.join(asked, matches, "left_anti")
            new = kept if rows is None else rows.select(*kept.columns).unionByName(kept)
        if touched:
            self._bucketed(new).withColumnRenamed("__bucket", "bucket").hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
        written = {n.split("=")[1] for n in children(self.spark, folder) if n.startswith("bucket=")}
        buckets = {b: s for b, s in before["buckets"].items() if int(b) not in touched} | dict.fromkeys(written, now)
        put(self.spark, f"{self.path}/manifests/{now}.json", json.dumps({"version": now, "buckets": buckets, "schema": schema.jsonValue()}), overwrite=False)
        self._expire()
        return now

    def rollback(self, version: int) -> None:
        """Forgets the snapshots after `version`, such as those of a run that died before its end."""
        for v in [v for v in self.versions() if v > version]:
            delete(self.spark, f"{self.path}/manifests/{v}.json")
            delete(self.spark, f"{self.path}/data/s={v}")

    def _expire(self) -> None:
        """Forgets all but the last `keep` snapshots and deletes the folders that only they named."""
        known = self.versions()
        old, stay = known[: -self.keep], known[-self.keep :]
        if not old:
            return
        named = {(b, s) for v in stay for b, s in self._manifest(v)["buckets"].items()}
        unused = {(b, s) for v in old for b, s in self._manifest(v)["buckets"].items()} - named
        for v in old:
            delete(self.spark, f"{self.path}/manifests/{v}.json")
        for b, s in unused:
            delete(self.spark, f"{self.path}/data/s={s}/bucket={b}")
