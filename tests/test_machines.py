"""Machines of few states by composing transitions, against steps one by one."""

import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from loomstone.plans import catalog
from loomstone.streaming import machines


def test_the_crawl_machines_states():
    assert len(machines.CRAWL.states) == 13
    for symbol, follows in machines.CRAWL.follows.items():
        assert [machines.crawl_step(*s, symbol) for s in machines.CRAWL.states] == [machines.CRAWL.states[i] for i in follows]
    with pytest.raises(ValueError, match="more than 200 states"):
        machines.Machine.explored(0, ("up",), lambda s, x: s + 1)


def test_compositions_of_segments():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 5, (4, 5))
    segment = np.sort(rng.integers(0, 9, 200))
    rows = table[rng.integers(0, 4, 200)]
    got = machines._compositions(rows, segment)
    for f, number in zip(got, np.unique(segment), strict=True):
        for start in range(5):
            state = start
            for row in rows[segment == number]:
                state = row[state]
            assert f[start] == state


@pytest.mark.parametrize(("parts", "batch"), [(1, 10_000), (7, 10_000), (23, 3)])
def test_composed_equals_steps(spark, parts, batch):
    """A key with most of the rows, ties of keys at borders of tasks and batches, unknown and null symbols, null keys."""
    rnd = random.Random(2)
    symbols = ["ok", "gone", "error", "error", "error", "error", "ingested", "requeue", "other", None]
    rows = [(rnd.choice(["hot", "hot", "hot", f"k{rnd.randint(0, 40)}", None]), i, rnd.choice(symbols)) for i in range(4000)]
    expected = {}
    for key, _, x in rows:
        if key is not None:
            expected[key] = machines.crawl_step(*expected.get(key, ("unknown", 0)), x)
    shuffled = rnd.sample(rows, len(rows))
    kept = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        df = spark.createDataFrame(shuffled, "key string, i int, x string")
        got = {r.key: (r.state, r.retries) for r in machines.crawl_fold(df, "key", F.col("i"), F.col("x")).collect()}
    finally:
        for n, v in kept.items():
            spark.conf.set(n, v)
    assert got == expected
    assert {r.key: (r.state, r.retries) for r in machines.crawl_fold(df.filter("key is null"), "key", F.col("i"), F.col("x")).collect()} == {}


def test_breakers_take_the_nearest_millisecond(spark, tmp_path):
    """Times between milliseconds, before 1970 too: the order of close calls and the end of a cooldown are as in the SQL."""
    import duckdb

    rnd = random.Random(5)
    rows = [(i, rnd.choice([-1, 1]) * rnd.randint(0, 3_000_000), rnd.choice("abc")) for i in range(3000)]
    # five failures, and a call 29,999.6 ms after them, which counts as 30,000: it may try
    rows += [(3001 + 3 * i, 10_000_000 + (29_999_600 if i == 5 else 0), "late") for i in range(6)]
    c = duckdb.connect()
    c.execute("CREATE TABLE e (event_id BIGINT, us BIGINT, event_type VARCHAR)")
    c.executemany("INSERT INTO e VALUES (?, ?, ?)", rows)
    c.execute(f"COPY (SELECT event_id, make_timestamp(us) AS ts, event_type FROM e) TO '{tmp_path}/events.parquet'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    expected = sorted(c.execute(catalog.oracle_sql()["breaker_replay"]).fetchall())
    assert sorted(tuple(r) for r in catalog.queries()["breaker_replay"](spark, str(tmp_path)).collect()) == expected
    assert ("late", "open", 5, 0, 6) in expected
