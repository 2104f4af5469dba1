"""A table of the current row per key that micro-batches keep up to date.

Rows lie in buckets by a hash of their key. A batch reads and rewrites only the
buckets it touches, into a folder of its own, and then writes its manifest: for every
bucket the batch that wrote it last. Readers take the latest manifest, so what they
read is the current rows and never the history; a batch that was killed before its
manifest leaves nothing to see, and one that is replayed after it changes nothing.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.operators.mutate import latest_by_key

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """``buckets`` should put some hundred thousand keys into a bucket; it is fixed
    when the table is begun. ``schema`` is that of the rows, keys included."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, keys: list[str], buckets: int = 16):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema

    # --- manifests: one small file per batch, whose appearance is the commit ---------
    def _path(self, *parts: str) -> str:
        return posixpath.join(self.root, *parts)

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """Batches that are committed."""
        files, path = self._files()
        at = path(self._path("manifest"))
        if not files.exists(at):
            return []
        done = [s.getPath() for s in files.listStatus(at) if s.isDirectory() and files.exists(path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Bucket -> batch whose files hold it, of a committed version (the latest)."""
        known = self.versions()
        if not known:
            return {}
        rows = self.spark.read.schema("bucket int, written long").parquet(self._path("manifest", f"v={known[-1] if version is None else version}"))
        return {r.bucket: r.written for r in rows.collect()}

    def _buckets(self, places: dict[int, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._path("data", f"v={v}", f"_bucket={b}") for b, v in sorted(places.items())])

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the table now, or as one of its versions left it; of ``buckets``
        only, where these are named."""
        places = self.manifest(version)
        return self._buckets(places if buckets is None else {b: places[b] for b in buckets if b in places})

    def written_by(self, batch: int) -> list[int]:
        """Buckets that a committed batch rewrote."""
        return [b for b, v in self.manifest(batch).items() if v == batch]

    def apply(self, rows: DataFrame, batch: int, merge: Merge) -> None:
        """Bring in one batch. ``merge(stored, fresh)`` gives the rows that replace the
        stored ones of the touched buckets; one per key. ``rows`` is evaluated once."""
        known = self.versions()
        if known and known[-1] >= batch:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        delta = self._path("delta")
        rows.select(*self.schema.names).withColumn("_bucket", bucket).write.mode("overwrite").parquet(delta)
        stored = self.spark.read.schema(T.StructType([*self.schema, T.StructField("_bucket", T.IntegerType())])).parquet(delta)
        touched = [r._bucket for r in stored.select("_bucket").distinct().collect()]  # at most ``buckets`` rows
        places = self.manifest()
        if touched:
            old = self._buckets({b: places[b] for b in touched if b in places})
            merged = merge(old, stored.drop("_bucket")).select(*self.schema.names).withColumn("_bucket", bucket)
            merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(self._path("data", f"v={batch}"))
        places |= dict.fromkeys(touched, batch)
        listed = self.spark.createDataFrame(sorted(places.items()), "bucket int, written long")
        listed.coalesce(1).write.mode("overwrite").parquet(self._path("manifest", f"v={batch}"))

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests before the last ``keep`` versions and the bucket folders
        that none of these names; their number is returned."""
        known = self.versions()
        live = {(v, b) for kept in known[-keep:] for b, v in self.manifest(kept).items()}
        files, path = self._files()
        for old in known[:-keep]:
            files.delete(path(self._path("manifest", f"v={old}")), True)
        gone = 0
        if files.exists(path(self._path("data"))):
            for version in files.listStatus(path(self._path("data"))):
                number = int(version.getPath().getName().split("=")[1])
                if number > known[-1]:
                    continue  # a batch on its way
                for bucket in files.listStatus(version.getPath()):
                    name = bucket.getPath().getName()
                    if name.startswith("_bucket=") and (number, int(name.split("=")[1])) not in live:
                        gone += bool(files.delete(bucket.getPath(), True))
        return gone


def newest(keys: list[str], version: list[str]) -> Merge:
    """Of stored and fresh rows of a key the one with the highest version stays."""
    return lambda stored, fresh: latest_by_key(stored.unionByName(fresh), keys, version)


def replacing(keys: list[str]) -> Merge:
    """A fresh row takes the place of the stored one; a batch has one per key."""
    return lambda stored, fresh: stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def adding(keys: list[str], sums: list[str]) -> Merge:
    """Counts of a key add up."""
    return lambda stored, fresh: stored.unionByName(fresh).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
