"""Registered queries whose counters are taken in the pass that writes their rows, and their SQL twins."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..operators import counters
from ..sources.folders import shared_folder
from . import catalog
from .streams import event_stream
from .views import table

_query = catalog._query
#: The sources that are declared; others are counted together.
_SOURCES = ("click", "view", "purchase")
_FUNNEL_SQL = f"""WITH e AS (SELECT CASE WHEN event_type IN {_SOURCES} THEN event_type ELSE 'other' END AS source, event_id % 6 AS k FROM events)
SELECT source, count(*) AS collected, count(*) FILTER (k < 4) AS normalized, count(*) FILTER (k < 2) AS "new", count(*) FILTER (k IN (2, 3)) AS already_seen,
    count(*) FILTER (k = 4) AS too_old, count(*) FILTER (k = 5) AS unnormalizable FROM e GROUP BY 1"""


def _outcome() -> Column:
    names = F.array(*map(F.lit, ("new", "new", "already_seen", "already_seen", "too_old", "unnormalizable")))
    return F.element_at(names, (F.col("event_id") % 6 + 1).cast("int"))


def _funnel() -> counters.Counters:
    return counters.funnel(_SOURCES, F.col("event_type"), F.col("outcome"))


@_query(_FUNNEL_SQL)
def observed_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel of a collection, counted while its kept rows are written."""
    seen = counters.Observed(_funnel())
    rows = seen.on(table(spark, sf_dir, "events").withColumn("outcome", _outcome()))
    rows.filter(F.col("outcome").isin("new", "already_seen")).write.parquet(f"{shared_folder(spark, 'kept')}/rows")
    return counters.funnel_totals(seen.table(spark))


@_query(_FUNNEL_SQL)
def observed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same funnel over a stream, as a listener hears it batch by batch."""
    heard = counters.StreamCounters(_funnel())
    spark.streams.addListener(heard)
    try:
        rows = heard.on(event_stream(spark, sf_dir).withColumn("outcome", _outcome())).filter(F.col("outcome").isin("new", "already_seen"))
        folder = shared_folder(spark, "kept")
        heard.wait(rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    finally:
        spark.streams.removeListener(heard)
    return counters.funnel_totals(heard.table(spark))


_CALLS_SQL = """WITH c AS (SELECT ['stage-a', 'stage-b', NULL][event_id % 3 + 1] AS stage, ['success', 'success', 'timeout', 'rateLimited', 'invalidOutput',
    'odd'][event_id % 6 + 1] AS outcome, event_type AS provider,
  CASE WHEN event_id % 6 > 1 THEN ['a', 'b', 'c'][event_id % 5 % 3 + 1] END AS error_type, CASE WHEN event_id % 4 <> 0 THEN user_id::DOUBLE END AS tokens FROM events)
SELECT 'outcome' AS split, coalesce(stage, 'other') AS first, CASE WHEN outcome = 'odd' THEN 'other' ELSE outcome END AS second, count(*) AS n, coalesce(sum(tokens), 0.0) AS tokens FROM c GROUP BY ALL
UNION ALL SELECT 'provider', CASE WHEN provider IN ('click', 'view') THEN provider ELSE 'other' END, NULL, count(*), NULL FROM c GROUP BY ALL
UNION ALL SELECT 'error', CASE WHEN error_type IN ('a', 'b') THEN error_type ELSE 'other' END, NULL, count(*), NULL FROM c GROUP BY ALL"""


@_query(_CALLS_SQL)
def observed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by stage and outcome, by provider and by type of error, counted while the failed ones are written."""
    i = F.col("event_id")
    pick = lambda k, *values: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    told = table(spark, sf_dir, "events").select(
        pick(i % 3, "stage-a", "stage-b", None).alias("stage"), pick(i % 6, "success", "success", "timeout", "rateLimited", "invalidOutput", "odd").alias("outcome"), F.col("event_type").alias("provider"),
        F.when(i % 6 > 1, pick(i % 5 % 3, "a", "b", "c")).alias("error_type"), F.when(i % 4 != 0, F.col("user_id")).alias("tokens"),
    )
    sets = [counters.Observed(c) for c in counters.calls(F.col("stage"), F.col("outcome"), F.col("provider"), F.col("error_type"), ("click", "view"), ("a", "b"), {"tokens": F.col("tokens")})]
    rows = told
    for c in sets:
        rows = c.on(rows)
    rows.filter("outcome <> 'success'").write.parquet(f"{shared_folder(spark, 'calls')}/failed")
    outcome, provider, error = (c.table(spark) for c in sets)
    one = lambda df, split, first: df.select(F.lit(split).alias("split"), F.col(first).alias("first"), F.lit(None).cast("string").alias("second"), "n", F.lit(None).cast("double").alias("tokens"))
    by_outcome = outcome.select(F.lit("outcome").alias("split"), F.col("stage").alias("first"), F.col("outcome").alias("second"), "n", "tokens")
    return by_outcome.unionByName(one(provider, "provider", "provider")).unionByName(one(error, "error", "error_type"))
