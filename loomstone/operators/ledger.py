"""The delivery ledger: operations with leases, and their chunks, from prepared to complete.

Two tables, as of one moment: operations (operation_id, status, claimed_by, claim_expires_at, updated_at, completed_at)
and chunks (operation_id, chunk_index, body, status, attempts, last_error, message_id, confirmed_at). Each function
returns the tables, or the one that it changes, after a step on all the rows that it names. The plans of steps grow into
each other: where several follow, the tables are best stored between them, as a ledger is.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

OPERATIONS = "operation_id string, status string, claimed_by string, claim_expires_at timestamp, updated_at timestamp, completed_at timestamp"
CHUNKS = "operation_id string, chunk_index int, body string, status string, attempts int, last_error string, message_id long, confirmed_at timestamp"
_KEY = ["operation_id", "chunk_index"]
# What a chunk's outcome makes of it.
SETTLED = {"confirmed": "confirmed", "rejected": "failed", "unknown": "uncertain"}


def prepare(operations: DataFrame, chunks: DataFrame, planned: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables with the planned chunks (operation_id, chunk_index, body) that they lack, as pending; known ones stay."""
    none = lambda kind: F.lit(None).cast(kind)
    new_chunks = planned.select(*_KEY, "body").join(chunks.select(*_KEY), _KEY, "left_anti")
    more = new_chunks.select(*_KEY, "body", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), none("string").alias("last_error"), none("long").alias("message_id"), none("timestamp").alias("confirmed_at"))
    new = planned.select("operation_id").distinct().join(operations.select("operation_id"), "operation_id", "left_anti")
    opened = new.select("operation_id", F.lit("pending").alias("status"), none("string").alias("claimed_by"), none("timestamp").alias("claim_expires_at"), now.alias("updated_at"), none("timestamp").alias("completed_at"))
    return operations.unionByName(opened), chunks.unionByName(more)


def mismatched(chunks: DataFrame, planned: DataFrame) -> DataFrame:
    """Operations whose stored chunks aren't those planned: another text, one too many or one missing."""
    both = chunks.select(*_KEY, F.col("body").alias("stored")).join(planned.select("operation_id").distinct(), "operation_id", "left_semi").join(planned.select(*_KEY, "body"), _KEY, "full")
    return both.filter(~F.col("stored").eqNullSafe(F.col("body"))).select("operation_id").distinct()


def claimable(owner: Column, now: Column) -> Column:
    """Whether an owner may take an operation: not complete, and free, its own, or with a lease that has ended."""
    free = F.col("claimed_by").isNull() | (F.col("claimed_by") == owner) | (F.col("claim_expires_at") < now)
    return (F.col("status") != "complete") & F.coalesce(free, F.lit(False))


def claim(operations: DataFrame, wanted: DataFrame, owner: str, now: Column, lease_ms: int) -> DataFrame:
    """Operations after an owner's try to take the wanted ones (operation_id); a column ``claimed`` more tells which it has got."""
    asked = operations.join(wanted.select("operation_id").distinct().withColumn("__asked", F.lit(True)), "operation_id", "left")
    got = F.coalesce(F.col("__asked"), F.lit(False)) & claimable(F.lit(owner), now)
    until = F.timestamp_millis(F.unix_millis(now) + lease_ms)
    changed = {"claimed": got, "claimed_by": F.when(got, F.lit(owner)).otherwise(F.col("claimed_by")), "claim_expires_at": F.when(got, until).otherwise(F.col("claim_expires_at")), "status": F.when(got, "in_progress").otherwise(F.col("status")), "updated_at": F.when(got, now).otherwise(F.col("updated_at"))}
    return asked.withColumns(changed).select(*operations.columns, "claimed")


def sendable(operations: DataFrame, chunks: DataFrame, owner: str) -> DataFrame:
    """Chunks that an owner of their operation may send: pending or failed ones of operations without an uncertain one or one being sent."""
    own = operations.filter((F.col("claimed_by") == owner) & (F.col("status") != "complete")).select("operation_id")
    open_ = F.bool_or(F.col("status").isin("uncertain", "sending")).over(W.partitionBy("operation_id"))
    held = chunks.join(own, "operation_id", "left_semi").withColumn("__open", F.coalesce(open_, F.lit(False)))
    return held.filter(F.col("status").isin("pending", "failed") & ~F.col("__open")).select(*chunks.columns)


def start(operations: DataFrame, chunks: DataFrame, begun: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables with the begun chunks (operation_id, chunk_index) being sent."""
    hit = chunks.join(begun.select(*_KEY).distinct().withColumn("__hit", F.lit(True)), _KEY, "left")
    on = F.col("__hit").isNotNull()
    sent = hit.withColumns({"status": F.when(on, "sending").otherwise(F.col("status")), "attempts": F.col("attempts") + on.cast("int"), "last_error": F.when(~on, F.col("last_error"))})
    return _touched(operations, begun, "in_progress", now), sent.select(*chunks.columns)


def _touched(operations: DataFrame, rows: DataFrame, status: str, now: Column) -> DataFrame:
    joined = operations.join(rows.select("operation_id").distinct().withColumn("__hit", F.lit(True)), "operation_id", "left")
    on = F.col("__hit").isNotNull()
    return joined.withColumns({"status": F.when(on, status).otherwise(F.col("status")), "updated_at": F.when(on, now).otherwise(F.col("updated_at"))}).select(*operations.columns)


def settle(operations: DataFrame, chunks: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables after sending. results: operation_id, chunk_index, outcome (confirmed, rejected or unknown), error, message_id.

    A rejected or unknown chunk fails its operation.
    """
    joined = chunks.join(results.select(*_KEY, F.col("outcome").alias("__o"), F.col("error").alias("__e"), F.col("message_id").alias("__m")), _KEY, "left")
    o = F.col("__o")
    status = F.coalesce(*(F.when(o == k, v) for k, v in SETTLED.items()), "status")
    ok = F.coalesce(o == "confirmed", F.lit(False))
    after = joined.withColumns({"status": status, "confirmed_at": F.when(ok, now).otherwise(F.col("confirmed_at")), "message_id": F.when(ok, F.col("__m")).otherwise(F.col("message_id")), "last_error": F.when(ok, F.lit(None)).when(o.isNotNull(), F.col("__e")).otherwise(F.col("last_error"))})
    return _touched(operations, results.filter(F.col("outcome") != "confirmed"), "failed", now), after.select(*chunks.columns)


def complete(operations: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """Operations whose chunks are all confirmed become complete and lose their claim."""
    whole = chunks.groupBy("operation_id").agg(F.bool_and(F.col("status") == "confirmed").alias("__whole"))
    on = F.coalesce("__whole", F.lit(False)) & (F.col("status") != "complete")
    marked = operations.join(whole, "operation_id", "left").withColumn("__on", on)
    kept = {c: F.when(~F.col("__on"), F.col(c)) for c in ("claimed_by", "claim_expires_at")}
    at = {c: F.when(F.col("__on"), now).otherwise(F.col(c)) for c in ("completed_at", "updated_at")}
    return marked.withColumns({**kept, **at, "status": F.when(F.col("__on"), "complete").otherwise(F.col("status"))}).select(*operations.columns)


def release(operations: DataFrame, owner: str, now: Column, only: Column | None = None) -> DataFrame:
    """Operations without an owner's claims (where only holds)."""
    claimed = F.col("claimed_by") == owner
    own = operations.withColumn("__own", F.coalesce(claimed if only is None else claimed & only, F.lit(False)))
    return own.withColumns({"claimed_by": F.when(~F.col("__own"), F.col("claimed_by")), "claim_expires_at": F.when(~F.col("__own"), F.col("claim_expires_at")), "updated_at": F.when(F.col("__own"), now).otherwise(F.col("updated_at"))}).select(*operations.columns)


def reconcile(operations: DataFrame, chunks: DataFrame, settled: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables with uncertain chunks settled by hand; others than uncertain ones and those being sent are left as they are.

    settled: operation_id, chunk_index, resolution (confirmed or retry). The operation becomes complete if all chunks are
    confirmed now, else pending, and free.
    """
    joined = chunks.join(settled.select(*_KEY, F.col("resolution").alias("__r")), _KEY, "left")
    on = F.col("__r").isNotNull() & F.col("status").isin("uncertain", "sending")
    sure = F.col("__on") & (F.col("__r") == "confirmed")
    # What is noted of a chunk settled by hand.
    note = F.when(sure, "manually reconciled as confirmed").otherwise("manual retry authorized after uncertain acknowledgement")
    marked = joined.withColumn("__on", on)
    after = marked.withColumns({"status": F.when(sure, "confirmed").when(F.col("__on"), "pending").otherwise(F.col("status")), "confirmed_at": F.when(sure, now).when(~F.col("__on"), F.col("confirmed_at")), "message_id": F.when(~F.col("__on"), F.col("message_id")), "last_error": F.when(F.col("__on"), note).otherwise(F.col("last_error"))})
    after = after.select(*chunks.columns, "__on")
    # only what was settled may become complete here; one aggregation tells both
    told = after.groupBy("operation_id").agg(F.coalesce(F.bool_or("__on"), F.lit(False)).alias("__hit"), F.coalesce(F.bool_and(F.col("status") == "confirmed"), F.lit(False)).alias("__whole"))
    hit = F.coalesce("__hit", F.lit(False))
    done = hit & F.col("__whole")
    freed = operations.join(told, "operation_id", "left").withColumns({"__hit": hit, "__done": done})
    free = {c: F.when(~F.col("__hit"), F.col(c)) for c in ("claimed_by", "claim_expires_at")}
    at = {"updated_at": F.when(F.col("__hit"), now).otherwise(F.col("updated_at")), "completed_at": F.when(F.col("__done"), now).when(~F.col("__hit"), F.col("completed_at"))}
    status = F.when(F.col("__done"), "complete").when(F.col("__hit"), "pending").otherwise(F.col("status"))
    return freed.withColumns({**free, **at, "status": status}).select(*operations.columns), after.drop("__on")
