"""Incremental ingestion: file streams into snapshot tables, recency cutoffs per source, and idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.buckets import BucketedTable
from ..operators.normalize import normalize_all, without_normalizer
from ..operators.store import Snapshots, upsert

RAW = "source string, source_id string, payload string"


def read_raw(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Stream of raw rows from JSON files that arrive in a folder."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files).json(path)


def cutoffs(history: DataFrame, now: Column, recent_days: float, most_days: float) -> DataFrame:
    """(source, cutoff): the window of each source reaches back to its own last success, within bounds."""
    from ..functions.dates import recency_window_days

    days = recency_window_days(now, F.col("last_success"), recent_days, most_days)
    return history.select("source", F.timestamp_millis((F.unix_millis(now) - days * 86_400_000).cast("long")).alias("cutoff"))


def split_late(postings: DataFrame, by_source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, late): late rows were published before their source's cutoff; undated ones are never late."""
    joined = postings.join(by_source, "source", "left")
    late = F.coalesce(F.col("published_at") < F.col("cutoff"), F.lit(False))
    return joined.filter(~late).drop("cutoff"), joined.filter(late).drop("cutoff").withColumn("reason", F.lit("too_old"))


def ingest(stream: DataFrame, table: Snapshots | BucketedTable, events: str, checkpoint: str, now: Callable[[], Column], by_source: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Upsert a raw stream into a table, batch by batch; late and unknown rows go to an event table. A bucketed table is rewritten in part only.

    Of a batch's rows of one posting the last to arrive counts: rows are numbered as they are read, before they are told
    apart by source. A batch that is run again gives the same table: upserts keep first sightings, and events are written
    under the batch's number. Runs until what is there is processed.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        numbered = batch.withColumn("pos", F.monotonically_increasing_id())
        postings = normalize_all(numbered, now())
        kept, late = split_late(postings, by_source()) if by_source else (postings, None)
        if isinstance(table, BucketedTable):
            table.upsert(kept)
        else:
            old = table.read()
            columns = [c for c in kept.columns if c != "pos"]
            base = old if old is not None else spark.createDataFrame([], kept.drop("pos").schema)
            table.write(upsert(base, kept.select(*columns, "pos")).select(*base.columns))
        refused = without_normalizer(batch)
        if late is not None:
            refused = refused.unionByName(late.select("source", "source_id", "reason"))
        refused.write.mode("overwrite").parquet(f"{events}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_stream(stream: DataFrame, ts: str, lateness: str = "14 days") -> DataFrame:
    """Rows by tumbling week (from Monday), final once the watermark has passed."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, "7 days", startTime="4 days").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), "n")


def first_seen_stream(stream: DataFrame, key: str, ts: str, lateness: str = "30 days") -> DataFrame:
    """First sightings only, with bounded state."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def append_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append an event stream to a table."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
