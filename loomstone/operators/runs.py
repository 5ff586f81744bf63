"""Run history: totals, recency cutoffs, health alerts and usage."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

LEAST_ATTEMPTS = 10


def contagious_sum(c: Column) -> Column:
    """Sum that is null as soon as one value is."""
    return F.when(F.count_if(c.isNull()) == 0, F.sum(c))


def collect_counters(rows: DataFrame, *keys: str) -> DataFrame:
    """Funnel of a collection by the keys. rows: outcome (new, already_seen, too_old, unnormalizable)."""
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("collected"), is_("new", "already_seen").alias("normalized"), is_("new").alias("new"), is_("already_seen").alias("already_seen"), is_("too_old").alias("too_old"), is_("unnormalizable").alias("unnormalizable")
    )


def totals_since(runs: DataFrame, since: Column) -> DataFrame:
    """Sums over the collection runs started since an instant (null: all); new less duplicates is never negative."""
    window = runs.filter(since.isNull() | (F.col("started_at") >= since))
    found = window.agg(F.coalesce(F.sum("collected"), F.lit(0)).alias("collected"), F.coalesce(F.sum("new"), F.lit(0)).alias("new"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"))
    return found.withColumn("remaining", F.greatest(F.lit(0), F.col("new") - F.col("duplicates")))


def sources_named(runs: DataFrame, column: str, pos: str = "started_at") -> DataFrame:
    """Distinct names in an array column of the runs, with the first run that has them."""
    return runs.select(F.explode(column).alias("source"), F.col(pos)).groupBy("source").agg(F.min(pos).alias("first"))


def last_success_by_source(runs: DataFrame) -> DataFrame:
    """Newest finish of a run that attempted the source and didn't fail on it."""
    tried = runs.select(F.explode(F.array_except("attempted_sources", "failed_sources")).alias("source"), "finished_at")
    return tried.groupBy("source").agg(F.max("finished_at").alias("last_success"))


def latest_run(runs: DataFrame, *keys: str, outcome: str | None = None) -> DataFrame:
    """The newest finished run of each key (of an outcome)."""
    done = runs.filter(F.col("finished_at").isNotNull())
    if outcome is not None:
        done = done.filter(F.col("outcome") == outcome)
    rest = [c for c in runs.columns if c not in keys]
    return done.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("finished_at", "run_id")).alias("r")).select(*keys, "r.*")


def consecutive(runs: DataFrame, key: str, order: str, n: int, tests: dict[str, Column]) -> DataFrame:
    """For each key with n rows at least: whether each test holds for all of its last n rows."""
    newest = runs.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("__r") <= n)
    held = newest.groupBy(key).agg(F.count("*").alias("__n"), *(F.bool_and(F.coalesce(t, F.lit(False))).alias(name) for name, t in tests.items()))
    return held.filter(F.col("__n") == n).drop("__n")


def count_summary(counts: Column) -> Column:
    """``a=1, b=2`` of a map's positive counts, by name."""
    positive = F.array_sort(F.map_entries(F.map_filter(counts, lambda k, v: v > 0)))
    return F.array_join(F.transform(positive, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")


def failure_rate_alert(runs: DataFrame, threshold: float) -> DataFrame:
    """Runs whose share of failed operations reaches the threshold: run_id, failed, total, text.

    runs: run_id, attempts, blocked, outcomes (map). Counts must add up, and there must be LEAST_ATTEMPTS attempts.
    """
    accounted = F.aggregate(F.map_values("outcomes"), F.lit(0).cast("long"), lambda s, x: s + x)
    total = F.col("attempts") + F.col("blocked")
    failed = total - F.coalesce(F.try_element_at("outcomes", F.lit("success")), F.lit(0))
    usable = (F.col("attempts") >= LEAST_ATTEMPTS) & (accounted == F.col("attempts"))
    rate = F.try_divide(failed.cast("double"), total)
    text = F.concat(failed.cast("string"), F.lit("/"), total.cast("string"), F.lit(" operations failed ("), F.round(rate * 100).cast("long").cast("string"), F.lit("%)"))
    return runs.filter(usable & (rate >= threshold)).select("run_id", failed.alias("failed"), total.alias("total"), text.alias("text"))


def missing_scores(runs: DataFrame) -> DataFrame:
    """Runs that left filtered postings without a score: run_id, missing, breakdown (unclassified where counts don't add up)."""
    missing = F.greatest(F.lit(0), F.col("filtered") - F.col("scored"))
    known = F.aggregate(F.map_values("failures"), F.lit(0).cast("long"), lambda s, x: s + x)
    breakdown = F.when(known == missing, count_summary(F.col("failures"))).otherwise(F.concat(F.lit("unclassified="), missing.cast("string")))
    return runs.filter(missing > 0).select("run_id", missing.alias("missing"), breakdown.alias("breakdown"))


def missed_runs(runs: DataFrame, now: Column, time: str, zone: str, hours: int) -> DataFrame:
    """One row: whether today's delivery (due at time) is missing, and whether collection is two cycles late.

    runs: kind, outcome, finished_at.
    """
    from ..functions.dates import wall_clock

    done = lambda kind: F.max(F.when((F.col("kind") == kind) & (F.col("outcome") == "success"), F.col("finished_at")))
    last = runs.agg(done("scoreAndDeliver").alias("deliver"), done("collect").alias("collect"))
    here = wall_clock(now, zone)
    due = F.substring(here, 12, 5) >= time
    today = F.coalesce(F.substring(wall_clock(F.col("deliver"), zone), 1, 10) == F.substring(here, 1, 10), F.lit(False))
    late = F.col("collect").isNull() | (F.unix_millis(now) - F.unix_millis("collect") > 2 * hours * 3_600_000)
    return last.select((due & ~today).alias("delivery_missed"), late.alias("collection_missed"))


def usage(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls, those without a usage report, and sums of tokens and cost by the keys."""
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if(F.col("tokens").isNull()).alias("without_usage"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def rate_limited(calls: DataFrame, most: int = 3, seconds: int = 600) -> DataFrame:
    """Calls with whether there were already ``most`` of the same principal and operation in the time before."""
    w = W.partitionBy("principal", "operation").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-seconds, 0)
    return calls.withColumn("limited", F.count("*").over(w) > most)


#: Recent runs by default, and at most.
RECENT, MOST_RECENT = 20, 200


def start_run(runs: DataFrame, run_id: str, kind: str, started_at: Column, triggered_by: str = "internal") -> DataFrame:
    """The run table with a run more, of which nothing else is known yet."""
    first = {"run_id": F.lit(run_id), "kind": F.lit(kind), "started_at": started_at, "triggered_by": F.lit(triggered_by)}
    row = runs.sparkSession.range(1).select(*(first.get(c, F.lit(None)).cast(runs.schema[c].dataType).alias(c) for c in runs.columns))
    return runs.unionByName(row)


def finish_runs(runs: DataFrame, finished: DataFrame) -> DataFrame:
    """The run table after runs have finished. finished: run_id and some of the table's columns.

    A null leaves the table's value as it is, and so does a column that finished lacks.
    """
    given = [c for c in finished.columns if c != "run_id"]
    new = finished.select("run_id", *(F.col(c).alias(f"__{c}") for c in given))
    joined = runs.join(new, "run_id", "left")
    return joined.select(*(F.coalesce(F.col(f"__{c}").cast(runs.schema[c].dataType), F.col(c)).alias(c) if c in given else F.col(c) for c in runs.columns))


def recent_runs(runs: DataFrame, kind: str, n: int = RECENT) -> DataFrame:
    """The newest runs of a kind, newest first; n from 1 to MOST_RECENT."""
    if isinstance(n, bool) or not isinstance(n, int) or not 1 <= n <= MOST_RECENT:
        raise ValueError(f"limit: an integer from 1 to {MOST_RECENT}")
    return runs.filter(F.col("kind") == kind).orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def events_of(events: DataFrame, fingerprints: DataFrame, newest: str = "occurred_at", tie: str = "event_id") -> DataFrame:
    """Events of the given postings with their place among the posting's (1: the newest)."""
    own = events.join(fingerprints.select("fingerprint").distinct(), "fingerprint", "left_semi")
    return own.withColumn("place", F.row_number().over(W.partitionBy("fingerprint").orderBy(F.desc(newest), F.desc(tie))))


def repeated(names: DataFrame, name: str) -> DataFrame:
    """Names that stand more than once, with their number."""
    return names.groupBy(name).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
