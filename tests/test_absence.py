"""Alerts for what did not come: a replayed stream against a plain walk, in any order of arrival."""

import datetime as dt
import json
import os
import random
from zoneinfo import ZoneInfo

import pyspark.sql.functions as F
import pytest

from loomstone.streaming import absence

HOUR = 3_600_000
START = 1_700_000_000_000


def by_hand(runs, rule, lateness):
    """All alerts as (key, since, due) of runs (key, ms, ok), up to the watermark."""
    watermark = max(ms for _, ms, _ in runs) - lateness
    out = set()
    for key in {k for k, _, _ in runs}:
        own = sorted({ms for k, ms, ok in runs if k == key and ok})
        if isinstance(rule, absence.Gap):
            span = round(rule.hours * HOUR)
            out |= {(key, t, t + span) for t in own if not any(t < u <= t + span for u in own) and t + span < watermark}
            continue
        zone = ZoneInfo(rule.zone)
        local = lambda ms: dt.datetime.fromtimestamp(ms / 1000, zone)
        first = min(ms for k, ms, _ in runs if k == key)
        day = local(first).date()
        while True:
            hour, minute = map(int, rule.time.split(":"))
            due = int(dt.datetime(day.year, day.month, day.day, hour, minute, tzinfo=zone).timestamp() * 1000)
            if due >= watermark:
                break
            if due >= first and not any(local(t).date() == day and t <= due for t in own):
                out.add((key, max((t for t in own if t <= due), default=None), due))
            day += dt.timedelta(days=1)
    return out


def replayed(spark, tmp_path, batches, rule, lateness):
    (tmp_path / "in").mkdir()
    for i, batch in enumerate(batches):
        with open(tmp_path / "in" / f"{i:03d}.json", "w") as f:
            f.writelines(json.dumps({"key": k, "ms": ms, "ok": ok}) + "\n" for k, ms, ok in batch)
        os.utime(f.name, (1_700_000_000 + i,) * 2)  # files are read in order of their times
    stream = spark.readStream.schema("key string, ms long, ok boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    alerts = absence.absences(stream, F.col("key"), F.timestamp_millis("ms"), F.col("ok"), rule, lateness)
    rows = absence.run_to_table(alerts, str(tmp_path / "out"), str(tmp_path / "checkpoint")).select("key", F.unix_millis("since"), F.unix_millis("due")).collect()
    assert len(rows) == len(set(rows))  # once each
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("rule", [absence.Gap(5), absence.Daily("07:30", "Europe/Lisbon")])
def test_a_replayed_stream_equals_a_walk(spark, tmp_path, rule):
    rnd = random.Random(5)
    runs = []
    for key in ("a", "b", "quiet"):
        at = START
        for _ in range(60 if key != "quiet" else 4):
            at += rnd.choice([HOUR, 2 * HOUR, 5 * HOUR, 5 * HOUR + 1, 9 * HOUR, 30 * HOUR])
            runs.append((key, at, rnd.random() < 0.7))
    runs.sort(key=lambda r: r[1] + rnd.randint(-2 * HOUR, 2 * HOUR))  # late by four hours at most
    runs += [("a", START + 5000 * HOUR, False)]  # moves the watermark on
    batches = [runs[i : i + 17] for i in range(0, len(runs), 17)]
    assert replayed(spark, tmp_path, batches, rule, "4 hours") == by_hand(runs, rule, 4 * HOUR)


def test_spans_that_just_fit_are_no_gaps():
    rule = absence.Gap(1)
    assert rule.settle([0, HOUR, 2 * HOUR + 1], None, 10 * HOUR) == ([(HOUR, 2 * HOUR), (2 * HOUR + 1, 3 * HOUR + 1)], [], None, None)
    assert rule.settle([0], None, HOUR) == ([], [0], None, HOUR + 1)
    assert rule.settle([0], None, HOUR + 1) == ([(0, HOUR)], [], None, None)


def test_days_over_a_change_of_clocks():
    """31 March 2024 has 23 hours in Lisbon."""
    rule = absence.Daily("07:30", "Europe/Lisbon")
    first = int(dt.datetime(2024, 3, 30, 0, 0, tzinfo=dt.UTC).timestamp() * 1000)
    cursor = rule.first(first)
    alerts, _, cursor, _ = rule.settle([first + HOUR], cursor, first + 60 * HOUR)
    assert [(due - first) / HOUR for _, due in alerts] == [30.5, 54.5]
    assert (cursor - first) / HOUR == 78.5


def test_keyless_rows_and_no_runs(spark, tmp_path):
    assert replayed(spark, tmp_path, [[(None, START, True)], [("k", None, True)]], absence.Gap(1), "1 hour") == set()
