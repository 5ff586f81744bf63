"""State, evidence, matching, ingestion and normalisation: the rules that tables alone don't show."""

import datetime as dt
import json
import os
import random
import unicodedata

import pyspark.sql.functions as F
import pytest

from loomstone.functions import text
from loomstone.operators import enrich, evidence, market, normalize, scoring, store
from loomstone.streaming import ingest, machines

NOW = dt.datetime(2026, 8, 20)


def first(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- normalisation


def test_white_space_and_letters_agree_on_driver_and_executors(spark):
    rng = random.Random(3)
    rows = ["Back End", "\t x y \n", "﻿a　b", "Йод й", "한국어 각", "がぎ", "क़x", "İstanbul", "\x1ca\x1fb", ""]
    rows += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x370, 0x1FFF), rng.randrange(0xAC00, 0xD7A3), 0x20, 0xA0])) for _ in range(10)) for _ in range(300)]
    rows = [r for r in rows if all(unicodedata.category(c) != "Cn" for c in r)]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select("t", text.normalize(F.col("t")).alias("a"), text.normalize_title(F.col("t")).alias("b"))
    for r in df.collect():
        assert (r.a, r.b) == (text.plain_normalize(r.t), text.plain_normalize(r.t, " ")), ascii(r.t)
    assert text.plain_normalize("Back End") == "back end"
    assert text.plain_normalize("Йод") == "иод"


def test_compatible_forms_are_folded(spark):
    got = first(spark, *(text.normalized_words(F.lit(x)).alias(x) for x in ("Ｃ＋＋ ﬁm", "№ 5 ㎏", "ẛ", "Ação.")))
    assert tuple(got) == (" c++ fim ", " no 5 kg ", " s ", " acao. ")


def test_blank_keys_give_no_posting(spark):
    raw = [("gupy", "1", json.dumps({"name": "\t\n", "careerPageName": "A"})), ("gupy", "2", json.dumps({"name": " Dev\n", "careerPageName": "\tA"})), ("nowhere", "3", "{}"), ("gupy", "4", "no json")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(raw)], "source string, source_id string, payload string, pos int")
    got = normalize.normalize_all(df, F.lit(NOW)).collect()
    assert [(r.source_id, r.title, r.company, r.pos) for r in got] == [("2", "Dev", "A", 1)]


def test_long_titles_are_numbered_in_chunks(spark):
    title = " ".join(["ababab", "aaaa"] * 200)
    got = first(spark, text.numbered_bigrams(F.lit(title)).alias("g")).g
    joined = " ".join(sorted(title.split()))
    counts: dict[str, int] = {}
    expected = []
    for i in range(len(joined) - 1):
        g = joined[i : i + 2]
        expected.append(((ord(g[0]) << 21) + ord(g[1])) * (1 << 21) + counts.get(g, 0))
        counts[g] = counts.get(g, 0) + 1
    assert sorted(got) == sorted(expected)
    assert first(spark, text.numbered_bigrams(F.lit("")).alias("g"), text.numbered_bigrams(F.lit("x")).alias("h")) == ([], [ord("x") * (1 << 21)])


# --- state

STATE = "fingerprint string, title string, first_seen_at timestamp, last_seen_at timestamp, score_failures int, last_score_failed_at timestamp, notified_at timestamp, claimed_at timestamp, claimed_by string"


def test_failures_are_counted_from_the_first_sighting_on(spark):
    batch = spark.createDataFrame([("a", "t", NOW, NOW, 0)], "fingerprint string, title string, first_seen_at timestamp, last_seen_at timestamp, pos int")
    table = store.upsert(spark.createDataFrame([], STATE), batch)
    ids = batch.select("fingerprint")
    assert table.first().score_failures == 0
    for n in range(1, 6):
        to_score, exhausted = store.split_exhausted(table)
        assert (to_score.count(), exhausted.count()) == (1, 0)
        table = store.record_score_failure(table, ids, F.lit(NOW))
        assert table.first().score_failures == n
    to_score, exhausted = store.split_exhausted(table)
    assert (to_score.count(), exhausted.count()) == (0, 1)
    table = store.upsert(table, batch)
    assert table.first().score_failures == 5
    cleared = store.clear_score_failures(table, ids).first()
    assert (cleared.score_failures, cleared.last_score_failed_at) == (0, None)


def test_rescore_frees_failed_rows_only(spark):
    rows = [("a", "t", NOW, NOW, 2, NOW, NOW, NOW, "run"), ("b", "t", NOW, NOW, 0, None, NOW, NOW, "run"), ("c", "t", NOW, NOW, None, None, NOW, None, None)]
    table = spark.createDataFrame(rows, STATE)
    got = {r.fingerprint: tuple(r)[4:] for r in store.rescore(table, table.select("fingerprint")).collect()}
    assert got == {"a": (0, None, None, None, None), "b": rows[1][4:], "c": rows[2][4:]}
    freed = store.rescore(table, table.select("fingerprint")).withColumns({"duplicate_of": F.lit(None), "discarded_at": F.lit(None)})
    assert [r.fingerprint for r in freed.filter(store.is_claimable(F.lit(NOW))).collect()] == ["a"]


def test_claims_and_marks(spark):
    rows = [("a", "t", NOW, NOW, 0, None, None, None, None), ("b", "t", NOW, NOW, 0, None, NOW, None, None)]
    table = spark.createDataFrame(rows, STATE).withColumns({"duplicate_of": F.lit(None).cast("string"), "discarded_at": F.lit(None).cast("timestamp"), "discard_reason": F.lit(None).cast("string")})
    claimed = store.claim(table, "r1", F.lit(NOW))
    assert {r.fingerprint: r.claimed_by for r in claimed.collect()} == {"a": "r1", "b": None}
    assert {r.fingerprint: r.claimed_by for r in store.release(claimed, "r1").collect()} == {"a": None, "b": None}
    notified = store.mark_notified(claimed, claimed.filter("fingerprint = 'a'"), F.lit(NOW))
    assert {r.fingerprint: r.claimed_by for r in store.release(notified, "r1").collect()} == {"a": "r1", "b": None}
    gone = store.discard(store.discard(table, table.filter("fingerprint = 'a'"), "first", F.lit(NOW)), table, "second", F.lit(NOW))
    assert {r.fingerprint: r.discard_reason for r in gone.collect()} == {"a": "first", "b": "second"}
    twice = table.withColumn("duplicate_of", F.lit("x"))
    assert store.restore_duplicate(twice, table.filter("fingerprint = 'a'")).filter("duplicate_of is null").count() == 1
    assert store.clear_duplicates(twice).filter("duplicate_of is null").count() == 2
    assert store.orphans_removed(table, table.filter("fingerprint = 'a'")).count() == 1
    assert store.add_columns(table, {"new": F.lit(1), "title": F.lit("no")}).select("title", "new").first() == ("t", 1)
    cache = spark.createDataFrame([("a", "h", 1), ("b", "h", 2)], "k string, h string, v int")
    more = spark.createDataFrame([("a", "h", 5, 0), ("a", "h", 6, 1), ("c", "h", 7, 2)], "k string, h string, v int, pos int")
    assert sorted(tuple(r) for r in store.cache_upsert(cache, more, ["k", "h"]).collect()) == [("a", "h", 6), ("b", "h", 2), ("c", "h", 7)]


def test_failed_scores_are_of_low_confidence(spark):
    got = spark.range(1).withColumns(scoring.failure_outcome("timeout")).first()
    assert (got.score, got.verdict, got.low_confidence, got.failure) == (0.0, "review", True, "timeout")


# --- evidence


PROFILE = evidence.Profile("Computação", "UFX", dt.date(2025, 2, 1), dt.date(2028, 12, 1), [evidence.Competency("Python", ("py",), ("Built an ETL in Python",)), evidence.Competency("Docker", (), ("Ran services in containers",))], english_level="B2", work_availability="Remoto")


def test_catalogue(spark):
    got = evidence.catalogue(PROFILE, NOW.date())
    assert got[0] == ("Academic enrollment", "Cursando o 4º período de Computação na UFX, com conclusão prevista para 2028.2.")
    assert [tag for tag, _ in got] == ["Academic enrollment", "English level", "Work availability", "Python", "Docker"]
    assert evidence.catalogue(PROFILE, dt.date(2030, 1, 1))[0][1] == "Concluiu Computação na UFX."
    assert "ainda não iniciou" in evidence.catalogue(PROFILE, dt.date(2024, 1, 1))[0][1]
    assert evidence.profile_keywords(PROFILE) == ["Python", "py", "Docker"]
    assert evidence.catalogue_text(PROFILE, NOW.date()).splitlines()[3] == "- [Python] Built an ETL in Python"
    with pytest.raises(ValueError, match="named twice"):
        evidence.Profile("c", "i", NOW.date(), NOW.date(), [evidence.Competency("a"), evidence.Competency("a")])


def test_only_real_and_applicable_quotes_are_admitted(spark):
    quotes = [
        ("- [Python] Built an ETL in Python", "Experiência com Python", "skill", True),
        ("Built an ETL in Python", "conhecer py e SQL", "skill", True),
        ("Built an ETL in Python ", "algo", "linguagem python", True),
        ("Built an ETL in python", "Python", "skill", False),  # not the same text
        ("Built an ETL in Python", "Pythonista", "skill", False),
        ("Built an ETL in Python", "Docker", "skill", False),
        ("Nível de inglês: B2.", "Inglês intermediário", "idioma", True),
        ("Nível de inglês: B2.", "Espanhol", "idioma", False),
        ("Remoto", "Disponibilidade remota", "local", False),  # no vocabulary for this tag
        ("An unrelated quote", "Python", "skill", False),
    ]
    schema = f"i int, matches array<{scoring.MATCH}>"
    rows = [(i, [{"requirement": {"text": t, "category": c, "weight": "mandatory", "verifiable": True}, "status": "met", "evidence": q}]) for i, (q, t, c, _) in enumerate(quotes)]
    rows.append((99, [{"requirement": {"text": "x", "category": "c", "weight": "mandatory", "verifiable": True}, "status": "not_met", "evidence": None}]))
    got = {r.i: r.g for r in spark.createDataFrame(rows, schema).select("i", evidence.guard(F.col("matches"), PROFILE, NOW.date()).alias("g")).collect()}
    for i, (q, *_, ok) in enumerate(quotes):
        m = got[i].matches[0]
        assert (m.status, m.evidence, got[i].rejected) == (("met", q, 0) if ok else ("not_met", None, 1)), quotes[i]
    assert got[99].rejected == 0 and got[99].matches[0].status == "not_met"


# --- matching


def test_matching_keeps_what_a_failed_try_finished(spark):
    def model(requirement):
        if requirement["text"] == "r2":
            raise TimeoutError
        return {"status": "met", "evidence": f"e {requirement['text']}"}

    requirement = lambda t: {"text": t, "category": "c", "weight": "mandatory", "verifiable": True}
    p = spark.createDataFrame([("a", "h", [requirement("r0"), requirement("r1"), requirement("r2")]), ("b", "h", [requirement("r0")]), ("c", "h", [])], f"fingerprint string, requirements_hash string, requirements array<{scoring.REQUIREMENT}>")
    cache = spark.createDataFrame([], f"fingerprint string, requirements_hash string, matches array<{scoring.MATCH}>, prompt_version string, model string, profile_hash string")
    partial = spark.createDataFrame([], f"fingerprint string, requirements_hash string, requirement_index int, match {scoring.MATCH}, prompt_version string, model string, profile_hash string")
    cached, fresh = enrich.match(p, cache, partial, model, "v", "m", "p")
    assert cached.count() == 0
    got = {r.fingerprint: r for r in fresh.collect()}
    assert (got["a"].failure, got["a"].matches) == ("TimeoutError", None)
    assert [m.status for m in got["b"].matches] == ["met"] and got["b"].finished == []
    assert got["c"].matches == [] and got["c"].failure is None
    rows = enrich.finished_matches(fresh, "v", "m", "p")
    assert sorted((r.requirement_index, r.match.evidence) for r in rows.collect()) == [(0, "e r0"), (1, "e r1")]
    calls = spark.sparkContext.accumulator(0)

    def second(requirement):
        calls.add(1)
        return {"status": "met", "evidence": None}

    _, again = enrich.match(p.filter("fingerprint = 'a'"), cache, rows.select(*partial.columns), second, "v", "m", "p")
    assert [m.status for r in again.collect() for m in r.matches] == ["met", "met", "not_met"]
    assert calls.value == 1


# --- ingestion


def test_last_arrival_counts_and_unknown_sources_are_recorded(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    same = {"title": "Dev", "company": "A", "location": "Rio"}
    rows = [
        {"source": "linkedin", "source_id": "1", "payload": json.dumps(same | {"location": "Rio (Remoto)", "link": "first"})},
        {"source": "indeed", "source_id": "2", "payload": json.dumps(same | {"job_url": "second"})},
        {"source": "linkedin", "source_id": "3", "payload": json.dumps(same | {"location": "Rio (Remoto)", "link": "third"})},
        {"source": "indeed", "source_id": "4", "payload": json.dumps(same | {"job_url": "last"})},
        {"source": "nowhere", "source_id": "5", "payload": "{}"},
    ]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    table = store.Snapshots(spark, f"file://{tmp_path}/table")
    ingest.ingest(ingest.read_raw(spark, f"file://{tmp_path}/in"), table, f"file://{tmp_path}/events", f"file://{tmp_path}/checkpoint", lambda: F.lit(NOW)).awaitTermination()
    assert [(r.source_id, r.source_url) for r in table.read().collect()] == [("4", "last")]
    assert [(r.source_id, r.reason) for r in spark.read.parquet(f"file://{tmp_path}/events").collect()] == [("5", "normalizer_missing")]


def test_weekly_and_first_seen_streams(spark, tmp_path):
    monday = dt.datetime(2026, 8, 17)
    rows = [("a", monday), ("a", monday + dt.timedelta(days=6)), ("b", monday + dt.timedelta(days=7)), ("c", monday + dt.timedelta(days=60))]
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    read = lambda: spark.readStream.schema("key string, ts timestamp").parquet(f"file://{tmp_path}/in")
    for name, made, sink in (("weeks", ingest.weekly_stream(read(), "ts"), "append"), ("seen", ingest.first_seen_stream(read(), "key", "ts"), "append")):
        q = made.writeStream.outputMode(sink).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r.week, r.n) for r in spark.table("weeks").collect()) == [(monday, 2), (monday + dt.timedelta(days=7), 1)]
    assert spark.table("seen").count() == 3
    ingest.append_events(read(), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 4


# --- folds and market


def test_folds_hold_one_state_at_a_time(spark):
    rows = [(k, i, "error" if i % 7 else "ok") for k in range(50) for i in range(60)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 1, "ok")], "key int, i int, x string").repartition(7)
    got = {r.key: (r.state, r.retries) for r in machines.crawl_fold(df, "key", F.col("i"), F.col("x")).collect()}
    state = ("unknown", 0)
    for i in range(60):
        state = machines.crawl_step(*state, "error" if i % 7 else "ok")
    assert got == {k: state for k in range(50)}


def test_study_plan_has_no_actions_and_orders(spark):
    corpus = spark.createDataFrame([(str(i), "Python e SQL" if i % 2 else "SQL", "A" if i else "B", None, "remote", i, NOW + dt.timedelta(days=7 * (i % 2))) for i in range(5)], "fingerprint string, title string, company string, location_city string, work_mode string, pos int, ts timestamp")
    plan = market.study_plan(corpus, F.col("title"), {"Python": ("py",), "SQL": ()}, corpus.filter("pos > 2"), ["SQL"], F.col("ts"))
    assert [tuple(r) for r in plan["demand"].collect()] == [("SQL", 5, 1.0), ("Python", 2, 0.4)]
    assert [tuple(r) for r in plan["gaps"].collect()] == [("Python", 1, 0.5)]
    assert [r.label for r in plan["companies"].collect()] == ["A", "B"]
    assert [r.n for r in plan["weekly"].collect()] == [3, 2]
    assert [tuple(r) for r in plan["regions"].collect()] == [("unknown", 5, 0)]
