"""Tables bucketed by key, of which an upsert reads and writes only the buckets that a batch's keys fall into.

A table is a Parquet folder partitioned by ``bucket``, a hash of the key modulo a fixed number. A batch's buckets (numbers
below that, so few) choose the partitions that are read, by partition pruning, and dynamic partition overwrite replaces
those only: files of other buckets aren't touched. One writer at a time; Spark's commit moves the new files in at the end
of the job, and an upsert that failed before that has changed nothing and can be run again, as upserts are idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from . import store

BUCKETS = 256


class BucketedTable:
    """A table in a folder, with a key column. buckets: fixed for the table's life; a bucket is written by one task."""

    def __init__(self, spark: SparkSession, path: str, key: str = "fingerprint", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket=*")
        return bool(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path))

    def read(self) -> DataFrame | None:
        """All rows; None before the first write."""
        return self.spark.read.parquet(self.path).drop("bucket") if self._exists() else None

    def _of(self, buckets: list[int]) -> DataFrame:
        return self.spark.read.parquet(self.path).filter(F.col("bucket").isin(buckets)).drop("bucket")

    def _write(self, df: DataFrame, tasks: int) -> None:
        """Replace the buckets of the rows. Rows without a key can't be found again and are left out."""
        placed = df.filter(F.col(self.key).isNotNull()).withColumn("bucket", self.bucket())
        placed.repartition(max(1, tasks), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def create(self, df: DataFrame) -> None:
        """Write a whole table, a row a key."""
        self._write(df, self.buckets)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets that the keys of a frame fall into."""
        return sorted(r.bucket for r in keys.filter(F.col(self.key).isNotNull()).select(self.bucket().alias("bucket")).distinct().collect())

    def change(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets that the keys fall into by what ``change`` makes of their rows; the buckets touched. Keys must stay."""
        found = self.touched(keys)
        if found:
            self._write(change(self._of(found)), len(found))
        return found

    def upsert(self, batch: DataFrame, pos: str = "pos") -> list[int]:
        """``store.upsert`` of a batch; the buckets touched. The first batch makes the table."""
        if not self._exists():
            self.create(store.latest(batch.filter(F.col(self.key).isNotNull()), self.key, pos).drop("sightings", pos))
            return list(range(self.buckets))
        return self.change(batch, lambda rows: store.upsert(rows, batch.filter(F.col(self.key).isNotNull()), self.key, pos))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys, read from their buckets only."""
        wanted = keys.select(self.key).distinct()
        return self._of(self.touched(wanted)).join(wanted, self.key, "left_semi")
