"""Registered queries of single functions and state changes over whole tables, and their SQL twins."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..functions import dates, identity, text
from ..operators import market, normalize, prefilter, runs, scoring, store
from ..sources import payloads
from ..sources.folders import shared_folder
from ..streaming import ingest, machines
from . import catalog, lifecycle
from .streams import event_stream
from .views import table

_query = catalog._query


def _pick(index: Column, *values: object) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


# --- state -----------------------------------------------------------------------------------------------------------


@_query(
    """WITH o AS (SELECT o_orderkey AS k, o_orderdate::TIMESTAMP AS made FROM orders)
SELECT k, CASE WHEN k % 4 = 0 THEN TIMESTAMP '1999-01-01' END AS notified_at, CASE WHEN k % 7 = 0 THEN made WHEN k % 5 = 0 THEN TIMESTAMP '1999-01-01' END AS
    discarded_at, CASE WHEN k % 7 = 0 THEN 'old' WHEN k % 5 = 0 THEN 'by hand' END AS discard_reason,
  CASE WHEN k % 9 = 0 THEN 0 WHEN k % 3 = 0 THEN k % 6 + 1 ELSE k % 6 END::INTEGER AS score_failures, CASE WHEN k % 4 = 0 OR k % 11 <> 0 THEN CASE WHEN k % 11 =
    0 OR k % 13 = 0 THEN 'run' END END AS claimed_by, 'eu' AS region FROM o WHERE k % 20 <> 1"""
)
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks, discards, failures and claims on a table, one after the other, and a new column; rows without a parent go."""
    k, at, now = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp"), F.lit("1999-01-01").cast("timestamp")
    o = table(spark, sf_dir, "orders")
    held = o.select(
        k.alias("fingerprint"), F.lit(None).cast("timestamp").alias("notified_at"), F.when(k % 7 == 0, at).alias("discarded_at"), F.when(k % 7 == 0, "old").alias("discard_reason"),
        (k % 6).cast("int").alias("score_failures"), F.lit(None).cast("timestamp").alias("last_score_failed_at"), F.when((k % 11 == 0) | (k % 13 == 0), "run").alias("claimed_by"), F.when((k % 11 == 0) | (k % 13 == 0), at).alias("claimed_at"),
    )
    ids = lambda n: o.filter(k % n == 0).select(k.alias("fingerprint"))
    held = store.mark_notified(held, ids(4), now)
    held = store.discard(held, ids(5), "by hand", now)
    held = store.record_score_failure(held, ids(3), now)
    held = store.clear_score_failures(held, ids(9))
    # only rows that 11 divides were claimed by this run; the others' claims stay
    held = held.withColumn("claimed_by", F.when(F.col("fingerprint") % 11 == 0, F.col("claimed_by")).otherwise(F.concat("claimed_by", F.lit("2"))))
    held = store.release(held, "run").withColumn("claimed_by", F.substring("claimed_by", 1, 3))
    held = store.add_columns(held, {"region": F.lit("eu"), "claimed_by": F.lit("never")})
    parents = o.filter(k % 20 != 1).select(k.alias("fingerprint"))
    return store.orphans_removed(held, parents).select(F.col("fingerprint").alias("k"), "notified_at", "discarded_at", "discard_reason", "score_failures", "claimed_by", "region")


@_query(
    """WITH l AS (SELECT l_orderkey % 500 AS a, l_linenumber AS b, l_returnflag AS c, 'v' || (l_orderkey % 2) AS d, l_partkey AS v, ((l_orderkey * 10 +
    l_linenumber) * 1000000 + l_partkey) * 2 + l_linenumber % 2 AS pos FROM lineitem)
SELECT a, b, c, d, arg_max(v, (pos % 2, pos)) AS v FROM l GROUP BY ALL"""
)
def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache with a key of four columns after a batch."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select((o % 500).alias("a"), n.alias("b"), F.col("l_returnflag").alias("c"), F.concat(F.lit("v"), (o % 2).cast("string")).alias("d"), F.col("l_partkey").alias("v"), (((o * 10 + n) * 1_000_000 + F.col("l_partkey")) * 2 + n % 2).alias("pos"))
    keys = ["a", "b", "c", "d"]
    empty = spark.createDataFrame([], rows.drop("pos").schema)
    first = store.cache_upsert(empty, rows.filter("pos % 2 = 0"), keys)
    return store.cache_upsert(first, rows.filter("pos % 2 = 1"), keys)


# --- identity, text, dates -------------------------------------------------------------------------------------------

_DIGITS = "'0123456789ABCDEFGHJKMNPQRSTVWXYZ'"


@_query(
    f"""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, substr(sha256(event_id::VARCHAR), 1, 20) AS x FROM events),
b AS (SELECT event_id, ms, list_transform(range(4), lambda i: ('0x' || substr(x, (i * 5 + 1)::INTEGER, 5))::BIGINT) AS parts FROM e)
SELECT event_id, array_to_string(list_transform(range(10), lambda i: substr({_DIGITS}, ((ms >> (5 * (9 - i))::INTEGER) & 31)::INTEGER + 1, 1)), '') ||
    array_to_string(list_transform(range(16), lambda i: substr({_DIGITS}, ((parts[(i // 4 + 1)::INTEGER] >> (5 * (3 - i % 4))::INTEGER) & 31)::INTEGER + 1, 1)), '')
    AS ulid FROM b"""
)
def sortable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sortable ids from an instant and 80 bits."""
    return table(spark, sf_dir, "events").select("event_id", identity.ulid(F.col("ts").cast("timestamp"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 20)).alias("ulid"))


@_query(
    """SELECT doc_id, sha256(coalesce(source, '') || chr(0) || coalesce(text, '')) AS content_hash, sha256(coalesce(source, '') || chr(0) || sha256(coalesce(text, ''))) AS operation, sha256(sha256(coalesce(source, '') || chr(0) || sha256(coalesce(text, ''))) || ':' || (doc_id % 7)) AS chunk FROM documents"""
)
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of contents, deliveries and chunks."""
    source = F.coalesce("source", F.lit(""))
    operation = identity.operation_id(source, F.sha2(F.coalesce("text", F.lit("")), 256))
    return table(spark, sf_dir, "documents").select("doc_id", identity.content_hash(source, F.col("text")).alias("content_hash"), operation.alias("operation"), identity.chunk_id(operation, F.col("doc_id") % 7).alias("chunk"))


@_query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), h AS (SELECT doc_id, substr(t, 1, 300) AS t FROM d), c AS (SELECT *,
    trim(regexp_replace(regexp_replace(t, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '[ ]+', ' ', 'g'), ' ') AS one FROM h)
SELECT doc_id, CASE WHEN length(one) > 60 THEN substr(one, 1, 60) || '…' ELSE one END AS label, regexp_replace(replace(t, '|', '\\|'),
    '[\\t\\n\\x0b\\f\\r ]*\\n[\\t\\n\\x0b\\f\\r ]*', ' ', 'g') AS cell, '<' || t || '> of ' || doc_id AS filled, '{"t": ' || doc_id || '}' AS answer, 'plan ' ||
    doc_id AS fenced FROM c"""
)
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log labels, table cells, filled and fenced templates, and the JSON in an answer."""
    t, i = F.substring(F.coalesce("text", F.lit("")), 1, 300), F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.log_label(t).alias("label"), text.escape_cell(t).alias("cell"), text.fill_template("<{{A}}> of {{B}}", {"A": t, "B": i}).alias("filled"),
        text.model_output(F.concat(F.lit('Sure:\n```json\n{"t": '), i, F.lit("}\n```\ndone"))).alias("answer"), text.fenced_template(F.concat(F.lit("x\n```text\nplan "), i, F.lit("\n```\n```\nother\n```"))).alias("fenced"),
    )


@_query(
    """SELECT event_id, strftime(ts - INTERVAL 3 HOURS, '%Y-%m-%d %H:%M') AS local, abs(epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-15') // 1000) <= 3.5 * 86400000 AS near,
  CASE WHEN event_id % 3 <> 2 THEN date_trunc('second', ts) END AS read FROM events"""
)
def clock_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall clocks of a zone, nearness, and timestamps from texts that aren't always such."""
    ts, i = F.col("ts").cast("timestamp"), F.col("event_id")
    written = F.when(i % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i % 3 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.lit("on "), F.date_format(ts, "dd/MM/yyyy")))
    return table(spark, sf_dir, "events").select("event_id", dates.wall_clock(ts, "America/Sao_Paulo").alias("local"), dates.within_days(ts, F.lit("2024-01-15").cast("timestamp"), 3.5).alias("near"), dates.tolerant_timestamp(written).alias("read"))


# --- matches, markets, runs ------------------------------------------------------------------------------------------


@_query(
    """WITH m AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber % 3 AS w, ['met', 'partial', 'not_met'][l_linenumber % 3 + 1] AS s, l_orderkey % 10 =
    3 AS bad, l_partkey % 4 = 0 AS known FROM lineitem)
SELECT k, bool_and(NOT bad OR n <> 1) AS valid, coalesce(string_agg(CASE WHEN known THEN 'Uses Docker ' ELSE 'Uses Kafka ' END || n, '; ' ORDER BY n) FILTER (s
    <> 'not_met' AND NOT known), '') AS missing FROM m GROUP BY 1"""
)
def match_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether matches fit their schema, and requirements that name no keyword of a profile."""
    li = table(spark, sf_dir, "lineitem")
    n, bad = F.col("l_linenumber"), (F.col("l_orderkey") % 10 == 3) & (F.col("l_linenumber") == 1)
    name = F.concat(F.when(F.col("l_partkey") % 4 == 0, "Uses Docker ").otherwise("Uses Kafka "), n.cast("string"))
    requirement = F.struct(name.alias("text"), F.lit("skill").alias("category"), F.when(bad, "urgent").otherwise(_pick(n % 3, "blocking", "mandatory", "desirable")).alias("weight"), F.lit(True).alias("verifiable"))
    status = _pick(n % 3, "met", "partial", "not_met")
    match = F.struct(n.alias("n"), F.struct(requirement.alias("requirement"), status.alias("status"), F.when(status != "not_met", "quote").alias("evidence")).alias("m"))
    grouped = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(match)), lambda x: x["m"]).alias("m"))
    return grouped.select("k", scoring.valid_matches(F.col("m")).alias("valid"), F.array_join(scoring.missing_terms(F.col("m"), ["docker"]), "; ").alias("missing"))


@_query("SELECT count(*) AS postings, count(*) FILTER (doc_id % 3 = 1 AND coalesce(text, '') <> '') AS extracted FROM documents")
def corpus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings, and those with requirements."""
    found = F.when(F.col("doc_id") % 3 == 1, F.filter(F.array(F.coalesce("text", F.lit(""))), lambda x: x != "")).when(F.col("doc_id") % 3 == 2, F.array().cast("array<string>"))
    return market.corpus_totals(table(spark, sf_dir, "documents").select(found.alias("requirements")))


@_query(
    """WITH r AS (SELECT event_type AS s, event_id AS i, ts FROM events), tried AS (SELECT unnest(CASE WHEN i % 3 = 0 THEN [s] ELSE [s, 'all'] END) AS source,
    s, i, ts FROM r), ok AS (SELECT source, max(ts) AS last_success FROM tried WHERE NOT (i % 2 = 0 AND source = s) GROUP BY 1),
d AS (SELECT e.event_id, e.event_type AS source, CASE WHEN e.event_id % 5 > 0 THEN e.ts END AS published_at FROM events e)
SELECT event_id, published_at IS NULL OR last_success IS NULL OR published_at >= last_success - INTERVAL 3 DAYS AS kept FROM d LEFT JOIN ok USING (source)"""
)
def recency_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept by the cutoff of their own source, three days before its last success."""
    e = table(spark, sf_dir, "events")
    own, i = F.col("event_type"), F.col("event_id")
    history = runs.last_success_by_source(e.select(F.when(i % 3 == 0, F.array(own)).otherwise(F.array(own, F.lit("all"))).alias("attempted_sources"), F.when(i % 2 == 0, F.array(own)).otherwise(F.array().cast("array<string>")).alias("failed_sources"), F.col("ts").alias("finished_at")))
    cut = history.select("source", (F.col("last_success") - F.expr("INTERVAL 3 DAYS")).alias("cutoff"))
    rows = e.select("event_id", own.alias("source"), F.when(i % 5 > 0, F.col("ts")).alias("published_at"))
    return rows.join(cut, "source", "left").select("event_id", prefilter.recent_enough(F.col("cutoff")).alias("kept"))


@_query(
    """WITH r AS (SELECT user_id AS run_id, count(*) AS filtered, count(*) FILTER (event_id % 4 > 0) AS scored, count(*) FILTER (event_id % 8 = 0) AS a,
    count(*) FILTER (event_id % 8 = 4 AND user_id % 2 = 0) AS b FROM events GROUP BY 1), m AS (SELECT *, filtered - scored AS missing FROM r)
SELECT run_id, missing, CASE WHEN a + b = missing THEN concat_ws(', ', CASE WHEN a > 0 THEN 'late=' || a END, CASE WHEN b > 0 THEN 'refused=' || b END) ELSE
    'unclassified=' || missing END AS breakdown FROM m WHERE missing > 0"""
)
def missing_score_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that left postings without a score, with the reasons where they add up."""
    i, u = F.col("event_id"), F.col("user_id")
    told = table(spark, sf_dir, "events").groupBy(u.alias("run_id")).agg(
        F.count("*").alias("filtered"), F.count_if(i % 4 > 0).alias("scored"), F.map_from_arrays(F.array(F.lit("refused"), F.lit("late")), F.array(F.count_if((i % 8 == 4) & (u % 2 == 0)), F.count_if(i % 8 == 0))).alias("failures")
    )
    return runs.missing_scores(told)


# --- sources and streams ---------------------------------------------------------------------------------------------


@_query(
    """WITH c AS (SELECT event_type AS query, event_id, CASE WHEN event_id % 9 > 0 THEN 'p' || event_id END AS source_id, row_number() OVER (PARTITION BY
    event_type ORDER BY event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT query, source_id, n > 1000 AS truncated, CASE WHEN query NOT IN ('click', 'view') THEN 'unknown source: ' || query END AS failure FROM c WHERE r <= 1000 AND source_id IS NOT NULL"""
)
def capped_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1,000 rows of each query that have an id, whether the cap cut it, and queries that no reader serves."""
    i = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(F.col("event_type").alias("query"), i, F.when(i % 9 > 0, F.concat(F.lit("p"), i.cast("string"))).alias("source_id"))
    kept = payloads.with_id(payloads.capped(raw, "query", "event_id", 1000))
    failed = payloads.unknown_sources(raw.select(F.col("query").alias("source")).distinct(), ("click", "view"))
    return kept.join(failed.select(F.col("source").alias("query"), "failure"), "query", "left").select("query", "source_id", "truncated", "failure")


@_query(
    r"""SELECT page_id, nullif(trim(regexp_extract(html || '<script type="application/ld+json"> {"id": ' || page_id || '} </script>', '(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1), ' ' || chr(9) || chr(10) || chr(13)), '') AS data FROM pages"""
)
def page_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first JSON-LD script of pages."""
    page = F.concat("html", F.lit('<script type="application/ld+json"> {"id": '), F.col("page_id").cast("string"), F.lit("} </script>"))
    return table(spark, sf_dir, "pages").select("page_id", payloads.json_ld(page).alias("data"))


@_query(
    "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n FROM events GROUP BY 1 HAVING date_trunc('week', any_value(ts)) + INTERVAL "
    "7 DAYS <= (SELECT max(ts) - INTERVAL 10 DAYS FROM events)"
)
def stream_final_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly counts of a stream that the watermark has made final."""
    folder = shared_folder(spark, "weeks")
    weeks = ingest.weekly_stream(event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "10 days")
    weeks.writeStream.format("parquet").option("path", f"{folder}/weeks").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(weeks.schema).parquet(f"{folder}/weeks").select(F.date_format("week", "yyyy-MM-dd").alias("week"), "n")


@_query(
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR coalesce(text, '') = '' THEN CASE WHEN doc_id % 2 = 0 THEN 'from the payload of ' || doc_id END ELSE 'own ' "
    "|| doc_id END AS description FROM documents"
)
def description_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions without tags, from the raw payload where they are missing."""
    i = F.col("doc_id")
    own = F.when((i % 3 != 0) & (F.coalesce("text", F.lit("")) != ""), F.concat(F.lit("own "), i.cast("string")))
    raw = F.when(i % 2 == 0, F.to_json(F.struct(F.concat(F.lit("from <b>the</b> payload of "), i.cast("string")).alias("description")))).otherwise('{"description": " "}')
    rows = normalize.backfill_description(table(spark, sf_dir, "documents").select("doc_id", own.alias("description"), raw.alias("raw_payload")))
    return rows.select("doc_id", normalize.plain_description(F.col("description")).alias("description"))


@_query(f"SELECT key, state IN ('unknown', 'retryable') AS todo FROM ({lifecycle.CRAWL_SQL}) s")
def crawl_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that have to be loaded (again)."""
    return catalog.crawl_states(spark, sf_dir).select("key", machines.needs_fetch(F.col("state")).alias("todo"))
