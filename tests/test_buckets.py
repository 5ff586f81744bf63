"""Bucketed tables: upserts equal those of whole tables, and touch the files of their keys' buckets only."""

import datetime as dt
import json
import os

import pyspark.sql.functions as F
import pytest

from loomstone.operators import store
from loomstone.operators.buckets import BucketedTable
from loomstone.streaming import ingest

NOW = dt.datetime(2026, 8, 20, 10)
SCHEMA = "fingerprint string, first_seen_at timestamp, last_seen_at timestamp, score_failures int, v int"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def held(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/table", buckets=16)
    assert table.read() is None
    rows = [(f"k{i}", NOW, NOW, i % 3, i) for i in range(2000)]
    table.create(spark.createDataFrame(rows, SCHEMA))
    return table


def batch_of(spark, held, wanted):
    """All keys of some buckets, two sightings each, and a new key there."""
    keys = held.read().filter(held.bucket().isin(wanted)).select("fingerprint")
    new = spark.createDataFrame([(f"new{i}",) for i in range(100)], "fingerprint string").filter(held.bucket().isin(wanted))
    later = F.lit(NOW + dt.timedelta(days=1))
    twice = keys.unionByName(new).crossJoin(spark.range(2).toDF("pos"))
    return twice.select("fingerprint", later.alias("first_seen_at"), later.alias("last_seen_at"), F.lit(None).cast("int").alias("score_failures"), (F.col("pos") + 7).cast("int").alias("v"), "pos")


def test_an_upsert_touches_its_buckets_only(spark, held, tmp_path):
    path = f"{tmp_path}/table"
    before, whole = files(path), held.read()
    whole = spark.createDataFrame(whole.collect(), whole.schema)
    batch = batch_of(spark, held, [3, 11])
    batch = spark.createDataFrame(batch.collect(), batch.schema)
    assert held.upsert(batch) == [3, 11]
    after = files(path)
    changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert {os.path.basename(os.path.dirname(f)) for f in changed} == {"bucket=3", "bucket=11"}
    assert {tuple(r) for r in held.read().collect()} == {tuple(r) for r in store.upsert(whole, batch).collect()}
    plan = held._of([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    held.upsert(batch)  # again: no change
    assert {tuple(r) for r in held.read().collect()} == {tuple(r) for r in store.upsert(whole, batch).collect()}


def test_lookups_and_changes(spark, held):
    keys = spark.createDataFrame([("k5",), ("k5",), ("none",), (None,)], "fingerprint string")
    assert [r.v for r in held.lookup(keys).collect()] == [5]
    touched = held.change(keys, lambda rows: store.mark(rows, keys, {"score_failures": F.lit(9)}))
    assert len(touched) in (1, 2)
    assert held.read().filter("score_failures = 9").count() == 1 and held.read().count() == 2000
    assert held.change(keys.filter("fingerprint is null"), lambda rows: rows) == []


def test_a_stream_into_buckets(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    table = BucketedTable(spark, f"file://{tmp_path}/table", buckets=8)
    for name, titles in (("a", ["Dev 0", "Dev 1", "Dev 0"]), ("b", ["Dev 1", "Dev 2"])):
        rows = [{"source": "gupy", "source_id": str(i), "payload": json.dumps({"name": t, "careerPageName": "A"})} for i, t in enumerate(titles)]
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
        ingest.ingest(ingest.read_raw(spark, f"file://{tmp_path}/in"), table, f"file://{tmp_path}/events", f"file://{tmp_path}/checkpoint", lambda: F.lit(NOW)).awaitTermination()
    assert sorted(r.title for r in table.read().collect()) == ["Dev 0", "Dev 1", "Dev 2"]
