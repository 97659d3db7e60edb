"""Keyed state on files in buckets, of which a batch rewrites only those that it meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BucketState:
    """A row for each key, below path, in buckets by a hash of the key.

    data/<version>/bucket=<b> holds a bucket as a version has written it, versions/<version> says for every bucket which
    version has written it last. That table, of as many rows as there are buckets, is written last: it brings all of a
    version's buckets in at once, and a version that failed before it is as if never begun. A version written again
    replaces itself. Readers of an earlier version keep theirs.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """The versions that are complete, in order."""
        files, at = self._files()
        folder = at(f"{self.path}/versions")
        if not files.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in files.listStatus(folder) if files.exists(at(f"{f.getPath()}/_SUCCESS")))

    def _written(self, version: int | None) -> dict[int, int]:
        if version is None:
            return {}
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/versions/{version}").collect()}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The state of a version, the last one if not said; of some buckets alone if asked."""
        known = self.versions()
        written = self._written(version if version is not None else known[-1] if known else None)
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(written.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, version: int, fresh: DataFrame, merge) -> DataFrame:
        """Make version of the last one before it and fresh rows; merge(before, fresh) gives the state of the keys of the
        buckets that fresh meets. Returns the state of these buckets as it was before."""
        before_this = [v for v in self.versions() if v < version]
        written = self._written(before_this[-1] if before_this else None)
        met = [r.b for r in fresh.select(self.bucket().alias("b")).distinct().collect()]  # buckets at most
        before = self.read(before_this[-1], met) if before_this else self.spark.createDataFrame([], self.schema)
        after = merge(before, fresh).select(*[f.name for f in self.schema]).withColumn("bucket", self.bucket())
        after.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/{version}")
        written |= dict.fromkeys(met, version)
        pointers = self.spark.createDataFrame(sorted(written.items()), "bucket int, version long").coalesce(1)
        pointers.write.mode("overwrite").parquet(f"{self.path}/versions/{version}")
        return before

    def forget(self, keep: int = 2) -> None:
        """Delete what only versions before the last keep need."""
        files, at = self._files()
        known = self.versions()
        kept, gone = known[-keep:], known[:-keep]
        needed = {(b, v) for k in kept for b, v in self._written(k).items()}
        for v in gone:
            for b in (b for b, w in self._written(v).items() if w == v and (b, v) not in needed):
                files.delete(at(f"{self.path}/data/{v}/bucket={b}"), True)
        for v in gone:
            files.delete(at(f"{self.path}/versions/{v}"), True)
