"""Counters in the pass: equal to a second scan, from one scan of the plan; on streams a batch once."""

import json
from types import SimpleNamespace

import pyspark.sql.functions as F
import pytest
from pyspark.sql import Row

from loomstone.operators import counters

ROWS = [("a", "new", 1.0), ("a", "new", None), ("a", "odd", 2.0), ("b", "too_old", 4.0), ("c", "already_seen", 8.0), (None, None, 16.0)]
EXPECTED = {("a", "new", 2, 1.0), ("a", "other", 1, 2.0), ("b", "too_old", 1, 4.0), ("other", "already_seen", 1, 8.0), ("other", "other", 1, 16.0)}


def counted():
    return counters.Counters("c", {"source": (F.col("s"), ("a", "b")), "outcome": (F.col("o"), counters.COLLECTED)}, {"cost": F.col("v")})


def test_counters_of_a_pass(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame(ROWS, "s string, o string, v double").repartition(3).write.parquet(path)
    seen = counters.Observed(counted())
    rows = seen.on(spark.read.parquet(path)).filter("v > 1")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan
    rows.write.parquet(str(tmp_path / "out"))
    assert {tuple(r) for r in seen.table(spark).collect()} == EXPECTED
    again = spark.read.parquet(path).groupBy("s", "o").count().collect()
    assert sum(r["count"] for r in again) == sum(r[2] for r in EXPECTED)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4  # the filter comes after the counters


def test_counters_of_nothing(spark):
    seen = counters.Observed(counted())
    seen.on(spark.createDataFrame([], "s string, o string, v double")).collect()
    assert seen.table(spark).collect() == []
    with pytest.raises(ValueError, match="more than 2000 counters"):
        counters.Counters("c", {d: (F.col(d), list(map(str, range(60)))) for d in "ab"})


def test_counters_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, part in enumerate((ROWS[:2], ROWS[2:5], ROWS[5:])):
        with open(tmp_path / "in" / f"{i}.json", "w") as f:
            f.writelines(json.dumps(dict(zip("sov", r, strict=True))) + "\n" for r in part)
    heard = counters.StreamCounters(counted())
    spark.streams.addListener(heard)
    stream = spark.readStream.schema("s string, o string, v double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    try:
        heard.wait(heard.on(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    finally:
        spark.streams.removeListener(heard)
    assert len(heard.batches) == 3
    assert {tuple(r) for r in heard.table(spark).collect()} == EXPECTED


def test_a_batch_counts_once(spark):
    heard = counters.StreamCounters(counters.Counters("c", {"k": (F.col("k"), ("x",))}))
    for n in (5, 7):  # the batch ran again
        heard.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(id="q", batchId=0, observedMetrics={"c": Row(n0=n, n1=1)})))
    heard.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(id="q", batchId=1, observedMetrics={"c": Row(n0=1, n1=0), "d": Row(n0=9)})))
    assert {tuple(r) for r in heard.table(spark).collect()} == {("x", 8), ("other", 1)}


def test_funnels_add_up(spark):
    counted = spark.createDataFrame([("a", "new", 3), ("a", "already_seen", 2), ("a", "other", 1), ("b", "unnormalizable", 4)], "source string, outcome string, n long")
    assert {tuple(r) for r in counters.funnel_totals(counted).collect()} == {("a", 6, 5, 3, 2, 0, 0), ("b", 4, 0, 0, 0, 0, 4)}
