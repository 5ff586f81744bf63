"""A sink that leaves one copy: ``df.writeStream.format("delivery_files")``.

Rows are delivered as JSON lines to files of a folder. A task writes a file of its own under ``pending`` and reports it; the
commit of a batch moves the batch's files to ``delivered`` and then writes the batch's entry in the ledger, by name of the
run and number of the batch. A batch that is in the ledger already was delivered before: what its tasks have written
again is deleted. A commit that broke off before its entry moves the same names over what it has moved. Readers take the
files that ledger entries name, so what isn't committed is never seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _files(path: str) -> tuple:
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(DeliveryFiles)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its place among the batch's tasks, its file (none without rows) and its number of rows."""

    part: int
    file: str | None
    rows: int


class DeliveryFiles(DataSource):
    """The format ``delivery_files``. Options: path; run, the name under which batches count (default: ``run``)."""

    @classmethod
    def name(cls) -> str:
        return "delivery_files"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DeliveryWriter:  # noqa: N802, FBT001
        return DeliveryWriter(self.options["path"], self.options.get("run", "run"))


class DeliveryWriter(DataSourceStreamWriter):
    """Writes and commits batches of one run."""

    def __init__(self, path: str, run: str) -> None:
        self.path, self.run = path, run

    def write(self, iterator: Iterator[Row]) -> Written:
        """A task's rows into a file of its own; tried again, a task writes another file, and the one that it reports counts."""
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        fs, root = _files(self.path)
        name, out, rows = f"{self.run}-{part:06d}-{uuid.uuid4().hex}", None, 0
        for row in iterator:
            if out is None:
                fs.create_dir(f"{root}/pending", recursive=True)
                out = fs.open_output_stream(f"{root}/pending/{name}")
            out.write((json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n").encode())
            rows += 1
        if out is not None:
            out.close()
        return Written(part, name if rows else None, rows)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        import pyarrow.fs as pafs

        fs, root = _files(self.path)
        told = [m for m in messages if m is not None]
        entry = f"{root}/ledger/{self.run}-{batchId:09d}.json"
        if fs.get_file_info(entry).type == pafs.FileType.File:
            self._remove(told)
            return
        for folder in ("delivered", "ledger"):
            fs.create_dir(f"{root}/{folder}", recursive=True)
        files = []
        for m in sorted(told, key=lambda m: m.part):
            if m.file is not None:
                name = f"{self.run}-{batchId:09d}-{m.part:06d}.jsonl"
                fs.move(f"{root}/pending/{m.file}", f"{root}/delivered/{name}")
                files.append({"file": name, "rows": m.rows})
        with fs.open_output_stream(f"{entry}.tmp") as f:
            f.write(json.dumps({"run": self.run, "batch": batchId, "files": files}).encode())
        fs.move(f"{entry}.tmp", entry)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._remove([m for m in messages if m is not None])

    def _remove(self, told: list[Written]) -> None:
        import pyarrow.fs as pafs

        fs, root = _files(self.path)
        for m in told:
            if m.file is not None and fs.get_file_info(f"{root}/pending/{m.file}").type == pafs.FileType.File:
                fs.delete_file(f"{root}/pending/{m.file}")


def delivered(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of the files that the ledger names."""
    import pyarrow.fs as pafs

    fs, root = _files(path)
    if fs.get_file_info(f"{root}/ledger").type != pafs.FileType.Directory:
        return spark.createDataFrame([], schema)
    entries = spark.read.schema("run string, batch long, files array<struct<file: string, rows: long>>").option("pathGlobFilter", "*.json").json(f"{path}/ledger")
    named = entries.selectExpr("explode(files) AS f").selectExpr("f.file AS name")
    lines = spark.read.schema(schema).json(f"{path}/delivered").selectExpr("*", "_metadata.file_name AS name") if fs.get_file_info(f"{root}/delivered").type == pafs.FileType.Directory else spark.createDataFrame([], schema).selectExpr("*", "'' AS name")
    return lines.join(named, "name", "left_semi").drop("name")
