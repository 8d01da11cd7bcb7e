"""Versioned tables by copy-on-write: a snapshot is a folder v=N, and a pointer row tells which is current.

Parquet tables know no MERGE, so a batch reads the current version, joins, and writes the next one; readers of the old version are
never disturbed, and a failed write leaves the pointer where it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import changes


class SnapshotTable:
    def __init__(self, spark: SparkSession, root: str, key: str, fields: list[str]):
        self.spark, self.root, self.key, self.fields = spark, root.rstrip("/"), key, fields

    def current(self) -> int:
        """The largest version that was completely written; 0 before the first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return max((int(f.getPath().getParent().getName()[2:]) for f in found), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={self.current() if version is None else version}")

    def create(self, rows: DataFrame) -> None:
        rows.select(self.key, *self.fields).withColumn("version", F.lit(1)).write.parquet(f"{self.root}/v=1")

    def apply(self, batch: DataFrame) -> DataFrame:
        """Write the next version; returns the change rows that led to it, read back from where they were appended."""
        at = self.current()
        old = self.read(at)
        log = f"{self.root}/changes/v={at + 1}"
        changes.tagged(changes.differences(old, batch, self.key, self.fields)).write.mode("overwrite").parquet(log)
        changes.merged(old, batch, self.key, self.fields).write.mode("overwrite").parquet(f"{self.root}/v={at + 1}")
        return self.spark.read.parquet(log)

    def evolve(self, column: str, kind: str, default: object) -> None:
        """A new nullable column with a default for the rows that exist, as the next version."""
        at = self.current()
        self.read(at).withColumn(column, F.lit(default).cast(kind)).write.mode("overwrite").parquet(f"{self.root}/v={at + 1}")
        self.fields.append(column)


class BucketedTable(SnapshotTable):
    """Versions that share what a batch leaves alone: rows are bucketed by a hash of the key, and a batch reads and writes only the buckets of its keys.

    data/v=N/bucket=K holds a bucket as version N left it; manifest/v=N says of every bucket whose version is current, and is written last, so it is the pointer. A
    batch of a few keys costs a few buckets, whatever the size of the table. At most `buckets` small rows reach the driver.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, fields: list[str], buckets: int = 64):
        super().__init__(spark, root, key, fields)
        self.buckets = buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int").alias("bucket")

    def current(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/v=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return max((int(f.getPath().getParent().getName()[2:]) for f in found), default=0)

    def manifest(self, version: int) -> dict[int, int]:
        """bucket -> the version that wrote it; buckets without rows are missing."""
        return {r.bucket: r.written for r in self.spark.read.parquet(f"{self.root}/manifest/v={version}").collect()} if version else {}

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        version = self.current() if version is None else version
        paths = [f"{self.root}/data/v={v}/bucket={b}" for b, v in sorted(self.manifest(version).items()) if only is None or b in only]
        shape = self.spark.read.parquet(f"{self.root}/shape/v={version}")
        return self.spark.read.schema(shape.schema).parquet(*paths) if paths else shape

    def _write(self, rows: DataFrame, version: int, kept: dict[int, int]) -> None:
        """rows: all of their buckets; kept: the other buckets."""
        rows.limit(0).write.mode("overwrite").parquet(f"{self.root}/shape/v={version}")
        by = rows.withColumn("bucket", self._bucket())
        by.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v={version}")
        fresh = [r.bucket for r in rows.select(self._bucket()).distinct().collect()]
        new = self.spark.createDataFrame([*kept.items(), *((b, version) for b in fresh)], "bucket int, written int")
        new.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}")

    def create(self, rows: DataFrame) -> None:
        self._write(rows.select(self.key, *self.fields).withColumn("version", F.lit(1)), 1, {})

    def apply(self, batch: DataFrame) -> DataFrame:
        """Write the next version; returns the change rows that led to it. A batch without rows makes a version like the last."""
        at = self.current()
        touched = {r.bucket for r in batch.select(self._bucket()).distinct().collect()}
        old, log = self.read(at, touched), f"{self.root}/changes/v={at + 1}"
        changes.tagged(changes.differences(old, batch, self.key, self.fields)).write.mode("overwrite").parquet(log)
        kept = {b: v for b, v in self.manifest(at).items() if b not in touched}
        self._write(changes.merged(old, batch, self.key, self.fields), at + 1, kept)
        return self.spark.read.parquet(log)

    def evolve(self, column: str, kind: str, default: object) -> None:
        """A new nullable column with a default for the rows that exist: a version that rewrites every bucket."""
        at = self.current()
        self._write(self.read(at).withColumn(column, F.lit(default).cast(kind)), at + 1, {})
        self.fields.append(column)
