"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch, at most: texts may be long, and both sides hold some batches at once.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the setting is absent, a local session (tests) gets a temporary folder for as long as it lives; elsewhere that
    is an error, since executors don't share their folders.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loomstone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_ROWS`` rows, so that workers' memory doesn't grow with the length of texts; smaller settings stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


class Scratch:
    """Tables of one operator call, written once and read back, so that no later stage recomputes them.

    ``keep`` cuts the lineage: a lost executor costs a reread. ``drop`` removes a table that no
    remaining plan reads. What the returned frame reads stays in the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loomstone/{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` as Parquet and return the table that was written."""
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        self.kept.append(kept)
        return kept

    def drop(self, *kept: DataFrame | None) -> None:
        """Delete kept tables."""
        for df in kept:
            if df is not None:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.kept = [x for x in self.kept if not any(x is df for df in kept)]

    def only(self, *needed: DataFrame | None) -> None:
        """Delete all kept tables but those that are still needed."""
        self.drop(*(x for x in self.kept if not any(x is df for df in needed)))
