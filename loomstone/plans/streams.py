"""Registered queries over streams, and their SQL twins."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..sources.folders import shared_folder
from ..streaming import absence, sink
from . import catalog
from .views import table

_query = catalog._query


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _absences(spark: SparkSession, sf_dir: str, rule: absence.Gap | absence.Daily, every: int) -> DataFrame:
    alerts = absence.absences(event_stream(spark, sf_dir), F.concat_ws("/", "event_type", (F.col("user_id") % 7).cast("string")), F.col("ts"), F.col("event_id") % every == 0, rule)
    folder = shared_folder(spark, "absences")
    return absence.run_to_table(alerts, f"{folder}/alerts", f"{folder}/checkpoint")


def _runs_sql(every: int) -> str:
    return f"""WITH r AS (SELECT event_type || '/' || (user_id % 7) AS key, epoch_us(ts) // 1000 AS ms, event_id % {every} = 0 AS ok FROM events), m AS (SELECT max(ms) - 3600000 AS w FROM r),
s AS (SELECT DISTINCT key, ms FROM r WHERE ok)"""


@_query(
    f"""{_runs_sql(5)}, n AS (SELECT *, lead(ms) OVER (PARTITION BY key ORDER BY ms) AS after FROM s)
SELECT key, make_timestamp(ms * 1000) AS since, make_timestamp((ms + 43200000) * 1000) AS due, 'no successful run in the last 12 h' AS text FROM n, m WHERE (after IS NULL OR after > ms + 43200000) AND ms + 43200000 < w"""
)
def missed_runs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 12 hours after a successful run without another one."""
    return _absences(spark, sf_dir, absence.Gap(12), 5)


@_query(
    f"""{_runs_sql(37)}, f AS (SELECT key, epoch_us(date_trunc('day', make_timestamp((min(ms) - 10800000) * 1000))) // 1000 + 79200000 AS due, min(ms) AS first FROM r GROUP BY 1),
d AS (SELECT key, unnest(range(CASE WHEN due >= first THEN due ELSE due + 86400000 END, (SELECT w FROM m), 86400000)) AS due FROM f)
SELECT d.key, make_timestamp(max(s.ms) * 1000) AS since, make_timestamp(any_value(d.due) * 1000) AS due, 'no successful run today (due 19:00 America/Sao_Paulo)' AS text FROM d LEFT JOIN s ON s.key = d.key AND s.ms <= d.due
GROUP BY d.key, d.due HAVING NOT coalesce(bool_or(date_trunc('day', make_timestamp((s.ms - 10800000) * 1000)) = date_trunc('day', make_timestamp((d.due - 10800000) * 1000))), false)"""
)
def missed_days_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without a successful run by 19:00 in São Paulo (three hours behind all year)."""
    return _absences(spark, sf_dir, absence.Daily("19:00", "America/Sao_Paulo"), 37)


@_query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 2 = 0")
def delivered_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a stream that was delivered twice: its checkpoint was lost in between, and the ledger knows its batches."""
    sink.register(spark)
    folder = shared_folder(spark, "delivery")
    rows = event_stream(spark, sf_dir).filter("event_id % 2 = 0").select("event_id", "user_id", "event_type")
    for n in range(2):
        write = rows.writeStream.format("delivery_files").option("path", f"{folder}/sink").option("checkpointLocation", f"{folder}/checkpoint-{n}")
        write.trigger(availableNow=True).start().awaitTermination()
    return sink.delivered(spark, f"{folder}/sink", rows.schema)
