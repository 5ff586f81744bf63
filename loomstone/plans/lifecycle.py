"""Registered queries of scoring, state, runs, delivery and rendering, and their SQL twins."""

from __future__ import annotations

import datetime as dt

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..functions import identity
from ..operators import buckets, delivery, enrich, evidence, ledger, market, model_output, render, runs, scorer, scoring, store
from ..sources import payloads
from ..sources.folders import shared_folder, stored
from . import answers, catalog
from .views import CRITERIA, POSTINGS_SQL, PROFILE_SKILLS, TAXONOMY, postings, table

_query = catalog._query
_TODAY = dt.date(2026, 8, 20)
PROFILE = evidence.Profile("Computação", "UFX", dt.date(2025, 2, 1), dt.date(2028, 12, 1), [evidence.Competency("Python", ("py",), ("Built an ETL in Python",)), evidence.Competency("Docker", ("containers",), ("Ran services in containers",))], english_level="B2", work_availability="Remoto")


def _instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _pick(values: tuple[str | None, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


# --- state -----------------------------------------------------------------------------------------------------------


@_query(
    "WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE coalesce(nullif(c_custkey % 8, 7), 0) + CASE WHEN c_custkey % 2 = 1 THEN 1 ELSE 0 "
    "END END AS failures FROM customer) SELECT c_custkey, failures::INTEGER AS failures, failures >= 5 AS exhausted FROM f"
)
def failure_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures counted and cleared, and who has reached the ceiling."""
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(k.cast("string").alias("fingerprint"), "c_custkey", F.when(k % 8 != 7, k % 8).cast("int").alias("score_failures"), F.lit(None).cast("timestamp").alias("last_score_failed_at"))
    failed = store.record_score_failure(base, base.filter(k % 2 == 1), _instant("2026-08-20"))
    to_score, exhausted = store.split_exhausted(store.clear_score_failures(failed, base.filter(k % 5 == 0)))
    part = lambda df, over: df.select("c_custkey", F.col("score_failures").alias("failures"), F.lit(over).alias("exhausted"))
    counted = part(to_score, False).unionByName(part(exhausted, True))
    return counted.withColumn("failures", F.coalesce("failures", F.lit(0)))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 0 ELSE 0 END::INTEGER AS failures, o_orderkey % 3 = 0 AS notified, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS claimed FROM orders")
def rescore_frees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose last scoring failed are free again: no failures, not notified of, not claimed; the others stay."""
    k = F.col("o_orderkey")
    t = _instant("2026-08-19")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (k % 3).cast("int").alias("score_failures"), F.when(k % 3 > 0, t).alias("last_score_failed_at"), t.alias("notified_at"), F.when(k % 2 == 0, t).alias("claimed_at"), F.when(k % 2 == 0, "run").alias("claimed_by"), k.cast("string").alias("fingerprint"))
    freed = store.rescore(rows, rows)
    return freed.select("o_orderkey", F.col("score_failures").alias("failures"), F.col("notified_at").isNotNull().alias("notified"), F.col("claimed_by").isNotNull().alias("claimed"))


@_query(
    f"WITH {POSTINGS_SQL} SELECT source_id, CASE WHEN location_kind = 'known' AND location_city IS NOT NULL THEN 'known' ELSE 'unknown' END AS "
    f"location_kind, CASE WHEN location_kind = 'known' THEN location_city END AS location_city, CASE pos % 3 WHEN 0 THEN '{{\"a\":1}}' WHEN 1 THEN "
    f"'{{\"corrupted\":true}}' END AS raw_payload FROM p"
)
def hydrated_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows as postings; broken payloads are marked."""
    p = postings(spark, sf_dir).withColumns({"last_seen_at": F.col("first_seen_at"), "raw_payload": _pick(('{"a":1}', '{"a":', None), F.col("pos") % 3)})
    return store.hydrated(p).select("source_id", "location_kind", "location_city", "raw_payload")


@_query(
    "WITH a AS (SELECT doc_id, source, '[{\"text\":\"' || source || '\"}]' AS r FROM documents WHERE doc_id IS NOT NULL) SELECT doc_id::VARCHAR AS fingerprint, doc_id % 3 = 0 AS extracted, l.quality AS quality "
    "FROM a LEFT JOIN labels l USING (doc_id)"
)
def corpus_of_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active postings with what the caches have of them: a third has requirements, and matches are looked up by their hash."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").filter(i.isNotNull())
    active = d.select(i.cast("string").alias("fingerprint"), F.concat(F.lit("h"), i.cast("string")).alias("content_hash"))
    requirements = F.array(F.struct(F.col("source").alias("text")))
    stamped = lambda df, version: df.withColumns({"prompt_version": F.lit(version), "model": F.lit("m")})
    extracted = d.filter(i % 3 == 0).select(i.cast("string").alias("fingerprint"), F.concat(F.lit("h"), i.cast("string")).alias("content_hash"), requirements.alias("requirements"))
    stale = extracted.withColumn("content_hash", F.lit("old"))
    of = F.when(i % 3 == 0, identity.requirements_hash(requirements)).otherwise(F.sha2(F.lit("[]"), 256))
    matched = d.join(table(spark, sf_dir, "labels"), "doc_id").select(i.cast("string").alias("fingerprint"), of.alias("requirements_hash"), F.col("quality").alias("matches"), F.lit("p").alias("profile_hash"))
    other = matched.withColumns({"profile_hash": F.lit("other"), "matches": F.lit(-1)})
    corpus = market.load_corpus(active, stamped(extracted.unionByName(stale), "a"), stamped(matched.unionByName(other), "b"), {"extract": "a", "match": "b"}, "m", "p")
    return corpus.select("fingerprint", F.col("requirements").isNotNull().alias("extracted"), F.col("matches").alias("quality"))


@_query("SELECT d.doc_id::VARCHAR AS fingerprint, l.quality AS matches, CASE WHEN d.doc_id % 3 = 0 THEN d.n_chars END AS requirements FROM documents d JOIN labels l USING (doc_id)")
def report_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings that have matches, with their requirements where there are any."""
    i = F.col("doc_id").cast("string").alias("fingerprint")
    d = table(spark, sf_dir, "documents")
    return market.report(d.select(i), table(spark, sf_dir, "labels").select(i, F.col("quality").alias("matches")), d.filter(F.col("doc_id") % 3 == 0).select(i, F.col("n_chars").alias("requirements")))


# --- scoring ---------------------------------------------------------------------------------------------------------

_ASKED = ("Experiência com Python", "Inglês avançado", "Docker e Linux", "algo mais")
_QUOTED = ("- [Python] Built an ETL in Python", "Nível de inglês: B2.", "Ran services in containers", "never in the profile", None)


@_query(
    "WITH m AS (SELECT l_orderkey, l_linenumber % 4 AS r, l_partkey % 5 AS q FROM lineitem) SELECT l_orderkey, count(*) FILTER (r = q AND r < 3) AS admitted, "
    "count(*) FILTER (q < 4 AND NOT (r = q AND r < 3)) AS rejected FROM m GROUP BY 1"
)
def evidence_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches whose evidence is a line of the profile about what is asked, and those that lose theirs."""
    requirement = F.struct(_pick(_ASKED, F.col("l_linenumber") % 4).alias("text"), F.lit("skill").alias("category"), F.lit("mandatory").alias("weight"), F.lit(True).alias("verifiable"))
    match = scoring.make_match(requirement, F.lit("met"), _pick(_QUOTED, F.col("l_partkey") % 5))
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(match).alias("m"))
    guarded = grouped.select("l_orderkey", evidence.guard(F.col("m"), PROFILE, _TODAY).alias("g"))
    return guarded.select("l_orderkey", F.size(F.filter("g.matches", lambda m: m["evidence"].isNotNull())).cast("long").alias("admitted"), F.col("g.rejected").cast("long").alias("rejected"))


_ALIGNED = "CASE WHEN len(tracks) = 0 THEN 0.4 WHEN list_contains(tracks, 'dev') OR list_contains(tracks, 'security') THEN 1.0 ELSE 0.7 END::DOUBLE"


@_query(
    f"{catalog.FILTERED_SQL} SELECT source_id, array_to_string(tracks, ',') AS tracks, round(CASE WHEN len(tracks) = 0 THEN 50.0 ELSE 55 + 45 * {_ALIGNED} "
    f"END, 6) AS score, 'review' AS verdict, true AS low_confidence FROM f"
)
def stub_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by tracks alone."""
    scored = scorer.scorer("stub")(postings(spark, sf_dir), CRITERIA, scorer.config_from({}))
    return scored.select("source_id", F.array_join("tracks", ",").alias("tracks"), F.round("score", 6).alias("score"), "verdict", "low_confidence")


@_query(f"{catalog._SCORED} SELECT l_orderkey, CASE WHEN verdict = 'review' THEN 'review' ELSE 'recommended' END AS section FROM o WHERE verdict <> 'discard' AND l_orderkey % 10 <> 3")
def delivered_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a digest delivers; postings that open later aren't among it."""
    s = catalog._scored(spark, sf_dir)
    placed = s.withColumn("section", delivery.section_of(F.col("verdict"), F.when(F.col("l_orderkey") % 10 == 3, F.lit(4))))
    return scorer.delivered(placed).select("l_orderkey", "section")


@_query(
    "WITH s AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'extraction_failed' WHEN 1 THEN 'matching_failed' END AS reason FROM documents WHERE doc_id % 10 "
    "< 8) SELECT reason, count(*) AS n FROM s WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'not_attempted_after_run_failure', count(*) FROM "
    "documents WHERE doc_id % 10 >= 8 HAVING count(*) > 0"
)
def score_failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by reason, and postings that a run didn't reach."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(i, i.cast("string").alias("fingerprint"))
    scored = d.filter(i % 10 < 8).withColumn("failure", F.when(i % 7 == 0, "extraction_failed").when(i % 7 == 1, "matching_failed"))
    return scorer.failure_counts(d, scored)


# --- runs ------------------------------------------------------------------------------------------------------------

RUNS = "run_id string, kind string, triggered_by string, started_at timestamp, finished_at timestamp, outcome string, collected long, scored long"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderstatus").alias("kind"), F.lit("internal").alias("triggered_by"), F.col("o_orderdate").cast("timestamp").alias("started_at"), none("timestamp").alias("finished_at"), none("string").alias("outcome"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("collected"), none("long").alias("scored"))


@_query(
    "SELECT o_orderkey::VARCHAR AS run_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'success' END AS outcome, CASE WHEN o_orderkey % 6 = 1 THEN 7 WHEN o_orderkey "
    "% 2 = 0 THEN o_custkey END AS collected FROM orders UNION ALL SELECT 'fresh', NULL, NULL"
)
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs started and finished; what a finish leaves out, or has as null, stays as it was."""
    i = F.col("run_id").cast("long")
    begun = runs.start_run(_runs(spark, sf_dir), "fresh", "collect", _instant("2026-08-20"))
    finished = _runs(spark, sf_dir).filter(i % 3 != 0).select("run_id", F.lit("success").alias("outcome"), F.when(i % 6 == 1, F.lit(7)).alias("collected"))
    return runs.finish_runs(begun, finished).select("run_id", "outcome", "collected")


@_query("SELECT o_orderkey::VARCHAR AS run_id, o_orderdate::TIMESTAMP AS started_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, run_id DESC LIMIT 20")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest runs of a kind (a limit is the feature)."""
    return runs.recent_runs(_runs(spark, sf_dir), "F").select("run_id", "started_at")


@_query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS place FROM events WHERE user_id % 4 = 0")
def events_of_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of some postings, newest first."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("fingerprint"), "event_id", F.col("ts").alias("occurred_at"))
    wanted = e.filter(F.col("fingerprint") % 4 == 0).select("fingerprint")
    return runs.events_of(e, wanted).select("event_id", "place")


@_query("SELECT n_regionkey AS name, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) > 1")
def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand more than once."""
    return runs.repeated(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("name")), "name")


@_query("SELECT event_type, count(*) AS n, sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS total, count(*) FILTER (event_id % 2 = 0) AS listed FROM events GROUP BY 1")
def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON columns read tolerantly: a record of numbers, and an array of strings that is broken in every other row."""
    e = table(spark, sf_dir, "events")
    record, listed = payloads.numeric_record(F.col("props")), payloads.string_array(F.when(F.col("event_id") % 2 == 0, F.lit('["a"]')).otherwise(F.lit('["a"')))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.try_element_at(record, F.lit("k"))).alias("total"), F.sum(F.size(listed)).alias("listed"))


# --- folds -----------------------------------------------------------------------------------------------------------

_OUTCOME = "CASE WHEN event_id % 3 = 0 THEN 'success' WHEN event_id % 3 = 1 THEN 'transient' WHEN event_id % 5 = 0 THEN 'permanent' ELSE 'transient' END"
_BLOCKED = "(a.state = 'open' AND e.at - a.opened < 30000)"
_TRYING = "(a.state = 'open' AND e.at - a.opened >= 30000)"
_OPENS = f"(e.x = 'transient' AND ({_TRYING} OR a.failures + 1 >= 5))"
#: The circuit breaker's steps as a fold over structs of state and event.
BREAKER_SQL = f"""WITH s AS (SELECT event_type AS key,
    list({{'state': '', 'failures': 0, 'opened': 0::BIGINT, 'blocked': 0, 'at': epoch_ms(ts)::BIGINT, 'x': {_OUTCOME}}} ORDER BY epoch_ms(ts), event_id) AS l FROM
    events WHERE event_type IS NOT NULL GROUP BY 1),
f AS (SELECT key, len(l) AS calls, list_reduce(l, lambda a, e: {{
  'state': CASE WHEN {_BLOCKED} THEN a.state WHEN e.x = 'success' THEN 'closed' WHEN e.x = 'permanent' THEN 'closed' WHEN {_OPENS} THEN 'open' ELSE 'closed' END,
  'failures': CASE WHEN {_BLOCKED} THEN a.failures WHEN e.x = 'success' OR (e.x = 'permanent' AND {_TRYING}) THEN 0 WHEN e.x = 'transient' AND NOT {_TRYING} THEN a.failures + 1 ELSE a.failures END,
  'opened': CASE WHEN NOT {_BLOCKED} AND {_OPENS} THEN e.at ELSE a.opened END,
  'blocked': a.blocked + CASE WHEN {_BLOCKED} THEN 1 ELSE 0 END, 'at': 0::BIGINT, 'x': ''}}, {{'state': 'closed', 'failures': 0, 'opened': 0::BIGINT, 'blocked':
    0, 'at': 0::BIGINT, 'x': ''}}) AS r FROM s)
SELECT key, r.state AS state, r.failures AS failures, r.blocked::BIGINT AS blocked, calls FROM f"""
_FREE = "a.state NOT IN ('quarantined', 'expired', 'ingested')"
_REQUEUED = "(e.x = 'requeue' AND a.state = 'quarantined')"
CRAWL_SQL = f"""WITH s AS (SELECT user_id AS key,
    list({{'state': '', 'retries': 0, 'x': ['ok', 'error', 'ingested', 'error', 'gone', 'requeue', 'error'][((event_id * 2654435761) >> 8) % 7 + 1]}} ORDER BY
    event_id) AS l FROM events WHERE user_id IS NOT NULL GROUP BY 1),
f AS (SELECT key, list_reduce(l, lambda a, e: {{
  'state': CASE WHEN {_REQUEUED} THEN 'unknown' WHEN {_FREE} AND e.x = 'ok' THEN 'collected' WHEN {_FREE} AND e.x = 'gone' THEN 'expired' WHEN {_FREE} AND e.x =
    'error' THEN CASE WHEN a.retries + 1 >= 5 THEN 'quarantined' ELSE 'retryable' END WHEN a.state = 'collected' AND e.x = 'ingested' THEN 'ingested' ELSE a.state
    END,
  'retries': CASE WHEN {_REQUEUED} THEN 0 WHEN {_FREE} AND e.x = 'error' THEN a.retries + 1 WHEN {_FREE} AND e.x = 'ok' THEN 0 ELSE a.retries END, 'x':
    ''}}, {{'state': 'unknown', 'retries': 0, 'x': ''}}) AS r FROM s)
SELECT key, r.state AS state, r.retries AS retries FROM f"""
_PACKED = (
    "list_filter(list_reduce(list_transform(%s, lambda p: [p]), lambda a, e: CASE WHEN len(a) > 0 AND length(a[-1]) + %d + length(e[1]) <= 1000 THEN a[:-2] "
    "|| [a[-1] || %s || e[1]] ELSE a || e END, []::VARCHAR[]), lambda p: p <> '')"
)
_SECTION, _ENTRY = "chr(10) || chr(10) || chr(10)", "chr(10) || chr(10)"
_PIECES = (
    "flatten(list_transform(flatten(list_transform(s, lambda p: CASE WHEN length(p) > 1000 THEN string_split(p, chr(10) || chr(10)) ELSE [p] END)), lambda "
    "e: list_transform(range(greatest(1, (length(e) + 999) // 1000)), lambda i: substr(e, i * 1000 + 1, 1000))))"
)
CHUNKS_SQL = f"""WITH m AS (SELECT 'c' || doc_id AS channel, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, sha256(channel || chr(0) || sha256(text)) AS operation_id, string_split(text, {_SECTION}) AS s FROM m),
c AS (SELECT operation_id, CASE WHEN len(list_filter(s, lambda p: length(p) > 1000)) = 0 THEN {_PACKED % ("s", 3, _SECTION)} ELSE {_PACKED % (_PIECES, 2, _ENTRY)} END AS c FROM s),
u AS (SELECT operation_id, unnest(range(len(c))) AS i, c FROM c)
SELECT operation_id, i::INTEGER AS chunk_index, sha256(c[i + 1]) AS content_hash FROM u"""


# --- answers of models -----------------------------------------------------------------------------------------------


@_query(
    """WITH d AS (SELECT doc_id, doc_id % 8 AS k, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT *, NOT blank AND k IN (0, 1, 3) AS found, CASE WHEN blank THEN 'blank' WHEN k IN (2, 5) THEN 'invalid_output' WHEN k = 4 THEN 'transport_failed'
    WHEN k = 6 THEN 'permanent_error' END AS failure,
  CASE WHEN blank THEN 0 WHEN k IN (2, 5) THEN 3 WHEN k = 4 THEN 4 WHEN k = 3 THEN 2 ELSE 1 END AS attempts FROM d),
e AS (SELECT *, unnest(CASE WHEN found THEN [0, 1] ELSE [NULL] END) AS i FROM r)
SELECT doc_id::VARCHAR AS fingerprint, i AS requirement_index, CASE WHEN found THEN 'r' || i || ' of ' || doc_id END AS text, CASE WHEN found THEN 'skill' END
    AS category, CASE WHEN found THEN ['mandatory', 'desirable'][i + 1] END AS weight, CASE WHEN found THEN true END AS verifiable,
  CASE WHEN failure IS NULL AND doc_id % 3 <> 0 THEN 'junior' END AS seniority, CASE WHEN failure IS NULL THEN (doc_id % 5)::INTEGER END AS experience_years, failure, attempts FROM e"""
)
def requirement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of every document by a table function, from a model that doesn't always answer well."""
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id").isNotNull())
    model = model_output.asking(answers.answer, lambda title, description: f"{title}\n\n{description}", model_output.EXTRACTION_SCHEMA, sleep=lambda seconds: None)
    name = F.col("doc_id").cast("string")
    return enrich.requirements_of(docs.select(name.alias("fingerprint"), name.alias("title"), F.col("text").alias("description")), model)


# --- tables in parts -------------------------------------------------------------------------------------------------


@_query(
    """WITH b AS (SELECT o_orderkey AS fingerprint, o_orderdate::TIMESTAMP AS at, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT
    o_orderkey AS fingerprint, o_orderdate::TIMESTAMP + INTERVAL 1 DAY AS at FROM orders WHERE o_orderkey % 50 = 0)
SELECT fingerprint, coalesce(b.at, n.at) AS first_seen_at, coalesce(n.at, b.at) AS last_seen_at, CASE WHEN n.at IS NOT NULL THEN 'seen again' ELSE b.status END
    AS status FROM b FULL JOIN n USING (fingerprint)"""
)
def bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed table after an upsert."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    o = table(spark, sf_dir, "orders")
    held = buckets.BucketedTable(spark, shared_folder(spark, "buckets"), buckets=64)
    held.create(o.filter(k % 3 != 0).select(k.alias("fingerprint"), at.alias("first_seen_at"), at.alias("last_seen_at"), F.col("o_orderstatus").alias("status")))
    later = at + F.expr("INTERVAL 1 DAY")
    held.upsert(o.filter(k % 50 == 0).select(k.alias("fingerprint"), k.alias("pos"), later.alias("first_seen_at"), later.alias("last_seen_at"), F.lit("seen again").alias("status")))
    return held.read()


# --- delivery and rendering ------------------------------------------------------------------------------------------


@_query(
    "WITH c AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 'confirmed' WHEN l_returnflag = 'N' THEN 'failed' WHEN l_linenumber % 2 = 1 THEN 'confirmed' ELSE 'pending' END AS s, l_returnflag = 'R' AS r FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_returnflag)) "
    "SELECT l_orderkey::VARCHAR AS operation_id, CASE WHEN bool_and(s = 'confirmed') THEN 'complete' WHEN bool_or(r) THEN 'pending' ELSE 'failed' END AS status, count(*) FILTER (s = 'confirmed') AS confirmed, count(*) FILTER (s = 'pending') AS pending, count(*) AS attempts, CASE WHEN bool_and(s = 'confirmed') OR bool_or(r) OR l_orderkey % 2 = 0 THEN NULL ELSE 'owner' END AS claimed_by FROM c GROUP BY l_orderkey"
)
def ledger_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries from prepared to settled, completed, released (half of them) and reconciled; the ledger is stored between steps."""
    folder = shared_folder(spark, "ledger")
    keep = lambda step, operations, chunks: (stored(operations, f"{folder}/{step}/operations"), stored(chunks, f"{folder}/{step}/chunks"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    named = lines.select(F.col("l_orderkey").cast("string").alias("operation_id"), F.col("l_linenumber").cast("int").alias("chunk_index"), "flag")
    planned = stored(named, f"{folder}/planned").withColumn("body", F.concat_ws(":", "operation_id", "chunk_index"))
    now = _instant("2026-08-20 10:00:00")
    nothing = lambda schema: spark.createDataFrame([], schema).filter(F.lit(False))  # noqa: E731  seen as empty by the planner
    operations, chunks = ledger.prepare(nothing(ledger.OPERATIONS), nothing(ledger.CHUNKS), planned, now)
    operations = stored(ledger.claim(operations, planned, "owner", now, 60_000).drop("claimed"), f"{folder}/claimed")
    operations, chunks = keep("started", *ledger.start(operations, chunks, stored(ledger.sendable(operations, chunks, "owner").select("operation_id", "chunk_index"), f"{folder}/ready"), now))
    outcome = F.when(F.col("flag") == "A", "confirmed").when(F.col("flag") == "N", "rejected").otherwise("unknown")
    operations, chunks = keep("settled", *ledger.settle(operations, chunks, planned.select("operation_id", "chunk_index", outcome.alias("outcome"), F.lit("e").alias("error"), F.lit(5).cast("long").alias("message_id")), now))
    operations = ledger.complete(operations, chunks, now)
    operations = ledger.release(operations, "owner", now, F.col("operation_id").cast("long") % 2 == 0)
    by_hand = planned.filter(F.col("flag") == "R").select("operation_id", "chunk_index", F.when(F.col("chunk_index") % 2 == 1, "confirmed").otherwise("retry").alias("resolution"))
    operations, chunks = ledger.reconcile(operations, chunks, by_hand, now)
    counted = chunks.groupBy("operation_id").agg(F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("status") == "pending").alias("pending"), F.sum("attempts").alias("attempts"))
    return operations.join(counted, "operation_id").select("operation_id", "status", "confirmed", "pending", "attempts", "claimed_by")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    strings = lambda on, *values: F.when(on, F.array(*map(F.lit, values))).otherwise(F.array().cast("array<string>"))
    gap = F.struct(F.lit("SQL").alias("text"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_name").alias("company"), F.concat(F.lit("Dev "), F.col("s_nationkey").cast("string")).alias("title"), (k % 101 + F.lit(0.5)).alias("score"), _pick(("apply", "review", "discard"), k % 3).alias("verdict"),
        F.when(k % 4 > 0, "known").otherwise("unknown").alias("location_kind"), F.when(k % 4 > 1, "Rio").alias("location_city"), _pick(("remote", "hybrid", "onsite", "unknown"), k % 4).alias("work_mode"), F.lit("gupy").alias("source"), F.when(k % 2 == 0, "https://a.example/1").alias("source_url"),
        F.when(k % 5 == 0, "matching_failed").alias("failure"), (k % 7 == 0).alias("low_confidence"), (k % 11 == 0).alias("input_truncated"), F.when(k % 3 == 0, "backend").alias("variant"), strings(k % 2 == 1, "a", "b").alias("highlights"), strings(k % 3 == 1, "x", "y").alias("missing_terms"), F.when(k % 6 == 0, F.array(gap, gap)).otherwise(F.array().cast("array<struct<text: string>>")).alias("critical_gaps"),
    )


_ENTRY_SQL = f"""SELECT s_suppkey, concat_ws(chr(10), 'Empresa: ' || s_name, 'Cargo: Dev ' || s_nationkey, 'Compatibilidade: ' || (s_suppkey % 101 + 1) ||
    '% · ' || ['candidatar', 'avaliar', 'descartar'][s_suppkey % 3 + 1],
  'Local: ' || CASE WHEN s_suppkey % 4 > 1 THEN 'Rio · ' ELSE '' END || ['Remoto', 'Híbrido', 'Presencial', 'Local não informado'][s_suppkey % 4 + 1],
    'Fonte: gupy', '→ ' || CASE WHEN s_suppkey % 2 = 0 THEN 'https://a.example/1' ELSE '{render.NO_LINK}' END,
  CASE WHEN s_suppkey % 5 = 0 THEN '{render.MANUAL.format(render.FAILURES["matching_failed"])}' WHEN s_suppkey % 7 = 0 THEN '{render.UNSURE}' END, CASE WHEN
    s_suppkey % 11 = 0 THEN '{render.CUT}' END, CASE WHEN s_suppkey % 3 = 0 THEN 'Currículo recomendado: backend' END,
  CASE WHEN s_suppkey % 2 = 1 THEN 'Pontos fortes: a; b' END, CASE WHEN s_suppkey % 3 = 1 THEN 'Termos ausentes no currículo: x, y' END, CASE WHEN s_suppkey % 6
    = 0 THEN 'Lacunas: SQL; SQL' END) AS entry FROM supplier"""


@_query(_ENTRY_SQL)
def digest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of scored postings as text."""
    e = _entries(spark, sf_dir)
    return e.select("s_suppkey", render.posting_entry(e).alias("entry"))


@_query(
    f"WITH e AS ({_ENTRY_SQL}) SELECT section, title || chr(10) || chr(10) || coalesce((SELECT string_agg(entry, chr(10) || chr(10) ORDER BY s_suppkey) FROM "
    f"e WHERE s_suppkey % 3 = k), '(nenhuma vaga)') AS text FROM (VALUES ('recommended', 'Recomendadas', 0), ('review', 'Vale avaliar', 1), "
    f"('opening_later', 'Abrem para você em breve', -1)) t(section, title, k)"
)
def digest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections of a digest, an empty one too."""
    e = _entries(spark, sf_dir)
    section = F.when(F.col("verdict") == "apply", "recommended").when(F.col("verdict") == "review", "review")
    return render.section_texts(e.select(section.alias("section"), F.col("s_suppkey").alias("pos"), render.posting_entry(e).alias("entry")).filter("section is not null"))


_RANKED = (
    "(SELECT string_agg(i || '. ' || skill || ' — ' || n || ' de ' || t || ' {0} (' || round(n / t * 100)::BIGINT || '%)', chr(10) ORDER BY i) FROM (SELECT "
    "*, row_number() OVER (ORDER BY n DESC, skill) AS i FROM {1}) WHERE i <= 10)"
)


@_query(
    f"""{catalog._MENTIONS}, f AS (SELECT skill, count(*) AS n, (SELECT n FROM t) AS t FROM u GROUP BY 1), g AS (SELECT skill, count(*) AS n, (SELECT n FROM k)
    AS t FROM u SEMI JOIN h USING (fingerprint) WHERE skill NOT IN ('The', 'In') GROUP BY 1),
w AS (SELECT strftime(date_trunc('week', first_seen_at), '%Y-%m-%d') AS week, count(*) AS n FROM p GROUP BY 1)
SELECT 'Corpus: ' || (SELECT n FROM t) || ' vagas · ' || (SELECT n FROM t) || ' com extração completa · ' || (SELECT n FROM k) || ' de alta compatibilidade' ||
    '{render.RULE.replace(chr(10), "' || chr(10) || '")}' || 'Lacunas mais frequentes (não cobertas pelo perfil)' || chr(10) || chr(10) ||
    {_RANKED.format("vagas de alta compatibilidade", "g")}
  || '{render.RULE.replace(chr(10), "' || chr(10) || '")}' || 'Tecnologias mais pedidas no mercado' || chr(10) || chr(10) ||
    {_RANKED.format("vagas com extração", "f")} || '{render.RULE.replace(chr(10), "' || chr(10) || '")}' || 'Volume por semana' || chr(10) || chr(10) || (SELECT
    string_agg(week || ': ' || n || ' vagas', chr(10) ORDER BY week) FROM w) AS text"""
)
def study_plan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study plan as one text; its parts are aggregates, only their few lines meet."""
    p = postings(spark, sf_dir)
    high = p.filter(F.col("pos") % 3 == 0)
    n, h = p.select(F.count("*")).scalar(), high.select(F.count("*")).scalar()
    mentions = market.skill_mentions(p, F.col("title"), TAXONOMY)
    gaps = render.ranked_lines(market.gap_analysis(mentions, high, PROFILE_SKILLS), h, "vagas de alta compatibilidade")
    demand = render.ranked_lines(market.skill_frequency(mentions, n), n, "vagas com extração")
    weeks = render.week_lines(market.weekly_volume(p, F.col("first_seen_at")))
    return spark.range(1).select(render.study_plan_text(n, n, h, gaps, demand, weeks).alias("text"))


@_query(
    "SELECT r_regionkey, concat_ws(chr(10), 'Resumo da execução', '', 'Coletadas: ' || r_regionkey, 'Novas após deduplicação: 2', 'Após pré-filtro: 1', "
    "'Pontuadas: 0', 'Fontes com falha: ' || CASE WHEN r_regionkey % 2 = 0 THEN 'a, b' ELSE 'nenhuma' END, 'Fontes truncadas pelo limite: nenhuma') AS text "
    "FROM region"
)
def digest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest's last section."""
    none = F.array().cast("array<string>")
    failed = F.when(F.col("r_regionkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none)
    return table(spark, sf_dir, "region").select("r_regionkey", render.run_summary(F.col("r_regionkey"), F.lit(2), F.lit(1), F.lit(0), failed, none).alias("text"))

