"""Model answers, the scorer's composition, the delivery ledger, rendering and run writes."""

import datetime as dt
import json

import pyspark.sql.functions as F
import pytest

from loomstone.functions import identity, text
from loomstone.operators import evidence, ledger, model_output, prefilter, render, runs, scorer, scoring, store
from loomstone.plans import catalog, lifecycle
from loomstone.sources import folders

NOW = dt.datetime(2026, 8, 20, 10)
PROFILE = evidence.Profile("Computação", "UFX", dt.date(2025, 2, 1), dt.date(2028, 12, 1), [evidence.Competency("Python", ("py",), ("Built an ETL in Python",))])


# --- model answers


def test_json_is_found_in_an_answer():
    assert model_output.json_part('```json\n{"a": [1]}\n```') == '{"a": [1]}'
    assert model_output.json_part('Sure: [1, {"b": 2}] done') == '[1, {"b": 2}]'
    assert model_output.json_part(" none ") == "none"


def test_answers_are_checked():
    fits = {"requirements": [{"text": "t", "category": "c", "weight": "mandatory"}], "seniority": None}
    assert model_output.problems(fits, model_output.EXTRACTION_SCHEMA) == []
    assert model_output.problems({"requirements": [{"text": "", "category": "c", "weight": "x"}]}, model_output.EXTRACTION_SCHEMA) == ["requirements.0.text: less than 1", "requirements.0.weight: not one of blocking, mandatory, desirable"]
    assert model_output.problems([], model_output.EXTRACTION_SCHEMA) == ["(root): expected object"]
    assert model_output.problems({"status": True}, model_output.MATCH_SCHEMA) == ["status: expected string"]
    assert model_output.problems({}, model_output.MATCH_SCHEMA) == ["status: missing"]


def asking(answers):
    prompts, waits = [], []

    def model(prompt):
        prompts.append(prompt)
        answer = answers[len(prompts) - 1]
        if isinstance(answer, Exception):
            raise answer
        return answer

    got = model_output.ask(model, "Q", model_output.MATCH_SCHEMA, sleep=waits.append, draw=lambda: 1.0)
    return got, prompts, waits


def test_the_two_budgets_are_apart():
    late = model_output.TransportError("timeout")
    got, prompts, waits = asking([late, "no json", late, '{"status": "x"}', late, '{"status": "met"}'])
    assert (got.ok, got.attempts, got.data) == (True, 6, {"status": "met"})
    assert waits == [0.5, 1.0, 2.0]
    assert prompts[0] == prompts[1] == "Q"
    assert prompts[2].startswith(f"Q\n\n{model_output.REPAIR}: Output was not valid JSON")
    assert "status: not one of met, partial, not_met" in prompts[4]


def test_failures_are_values():
    got, _, waits = asking([model_output.TransportError("rateLimited", retry_after_ms=7000, http_status=429)] * 4)
    assert (got.reason, got.attempts, got.batch_fatal, waits) == ("transport_failed", 4, False, [7.0] * 3)
    assert got.diagnostic["kind"] == "transport_failed" and got.diagnostic["http_status"] == 429
    got, _, waits = asking([model_output.TransportError("authError", "revoked")])
    assert (got.reason, got.attempts, got.batch_fatal, waits) == ("permanent_error", 1, True, [])
    assert asking([model_output.TransportError("requestError")])[0].batch_fatal is False
    got, *_ = asking(["x"] * 3)
    assert (got.reason, got.diagnostic["kind"], got.attempts) == ("invalid_output", "output_invalid_json", 3)
    assert asking(['{"status": 1}'] * 3)[0].diagnostic["kind"] == "output_schema_rejected"
    assert asking([RuntimeError("gone")] * 4)[0].diagnostic["category"] == "networkError"


def test_waits():
    assert [model_output.retry_after_ms(h, 0) for h in ("2", "100", "-1", "", None, "soon", "inf", "Thu, 01 Jan 1970 00:00:05 GMT", "Thu, 01 Jan 1970 01:00:00 GMT")] == [2000, 30_000, None, None, None, None, None, 5000, 30_000]
    assert model_output.retry_after_ms("Thu, 01 Jan 1970 00:00:05 GMT", 9) == 0
    assert [model_output.backoff_ms(a, lambda: 1.0) for a in range(1, 7)] == [500, 1000, 2000, 4000, 8000, 8000]


# --- the scorer


def test_composition(spark):
    calls = spark.sparkContext.accumulator(0)
    r = lambda t, w="mandatory": {"text": t, "category": "skill", "weight": w, "verifiable": True}

    def extract(title, description):
        calls.add(1)
        if description == "fails":
            raise TimeoutError
        return {"requirements": [r("Experiência com Python"), r("Docker"), r("Kafka", "desirable")], "seniority": "junior", "experience_years": 1}

    def match(requirement):
        if requirement["text"] == "Kafka":
            return {"status": "not_met", "evidence": None}
        return {"status": "met", "evidence": "- [Python] Built an ETL in Python"}  # for Docker it isn't applicable

    p = spark.createDataFrame([("a", "Dev", "A text"), ("b", "Dev", "fails"), ("c", "Chef", " ")], "fingerprint string, title string, description string")
    extractions = spark.createDataFrame([], f"fingerprint string, content_hash string, requirements array<{scoring.REQUIREMENT}>, seniority string, experience_years int, prompt_version string, model string")
    matches = spark.createDataFrame([], f"fingerprint string, requirements_hash string, matches array<{scoring.MATCH}>, prompt_version string, model string, profile_hash string")
    partial = spark.createDataFrame([], f"fingerprint string, requirements_hash string, requirement_index int, match {scoring.MATCH}, prompt_version string, model string, profile_hash string")
    criteria = prefilter.Criteria(title_required=("dev",), tracks={"dev": ("dev",)})
    models = scorer.Models(extract, match, "m", "a", "b")
    run = scorer.scorer("api")(p, extractions, matches, partial, models, criteria, scorer.config_from({}), PROFILE, "p", NOW.date())
    got = {r.fingerprint: r for r in run.scored.collect()}
    assert got["a"].failure is None and got["a"].evidence_rejected == 1
    assert got["a"].mandatory_coverage == 0.5 and got["a"].desirable_coverage == 0
    assert got["a"].score == pytest.approx(35 * 0.5 + 45)
    assert got["a"].highlights == ["Built an ETL in Python"]
    assert [g.text for g in got["a"].critical_gaps] == ["Docker"]
    assert (got["b"].failure, got["b"].verdict, got["b"].low_confidence) == ("extraction_failed", "review", True)
    assert (got["c"].failure, got["c"].tracks, got["c"].low_confidence) == (None, [], True)
    assert [r.fingerprint for r in run.extractions.collect()] == ["a"]
    assert {r.fingerprint: (r.seniority, r.experience_years) for r in run.fields.collect()} == {"a": ("junior", 1), "c": (None, None)}
    before = calls.value
    again = scorer.model_scores(p, run.extractions, run.matches, partial, models, criteria, scorer.config_from({}), PROFILE, "p", NOW.date())
    assert {r.fingerprint: r.score for r in again.scored.collect()} == {k: v.score for k, v in got.items()}
    assert calls.value == before + scorer.enrich.RETRIES  # only the failing one is asked again
    table = spark.createDataFrame([("a", "senior", None), ("c", "mid", 3)], "fingerprint string, seniority string, experience_years int")
    assert {r.fingerprint: (r.seniority, r.experience_years) for r in store.set_extracted(table, run.fields).collect()} == {"a": ("junior", 1), "c": ("mid", 3)}


def test_scorers_by_name(spark):
    with pytest.raises(ValueError, match="none of stub, api"):
        scorer.scorer("other")
    config = scorer.config_from({"scoring": {"weights": {"mandatory": 50, "desirable": 10, "track": 40}, "thresholds": {"apply": 80, "review": 50}, "blockingCap": 30}})
    assert (config.mandatory, config.apply, config.blocking_cap, config.min_requirements) == (50, 80, 30, 3)
    with pytest.raises(ValueError, match="must sum to 100"):
        scorer.config_from({"scoring": {"weights": {"mandatory": 50}}})


# --- ledger


def test_leases(spark):
    later = NOW + dt.timedelta(minutes=1)
    rows = [("free", "pending", None, None), ("own", "failed", "me", later), ("taken", "in_progress", "you", later), ("ended", "in_progress", "you", NOW - dt.timedelta(seconds=1)), ("done", "complete", None, None)]
    operations = spark.createDataFrame([(*r, NOW, None) for r in rows], ledger.OPERATIONS)
    got = ledger.claim(operations, operations.filter("operation_id <> 'x'"), "me", F.lit(NOW), 60_000)
    assert {r.operation_id: (r.claimed, r.claimed_by) for r in got.collect()} == {"free": (True, "me"), "own": (True, "me"), "taken": (False, "you"), "ended": (True, "me"), "done": (False, None)}
    assert {r.claim_expires_at for r in got.filter("claimed").collect()} == {later}


def test_uncertain_chunks_hold_an_operation_back(spark):
    plan = spark.createDataFrame([("o", 0, "x"), ("o", 1, "y"), ("p", 0, "z")], "operation_id string, chunk_index int, body string")
    operations, chunks = ledger.prepare(spark.createDataFrame([], ledger.OPERATIONS), spark.createDataFrame([], ledger.CHUNKS), plan, F.lit(NOW))
    assert ledger.prepare(operations, chunks, plan, F.lit(NOW))[1].count() == 3
    assert ledger.mismatched(chunks, plan).count() == 0
    assert [r.operation_id for r in ledger.mismatched(chunks, plan.filter("body <> 'y'")).collect()] == ["o"]
    operations = ledger.claim(operations, plan, "me", F.lit(NOW), 1000).drop("claimed")
    operations, chunks = ledger.start(operations, chunks, plan.filter("chunk_index = 0"), F.lit(NOW))
    results = spark.createDataFrame([("o", 0, "unknown", "lost", None), ("p", 0, "confirmed", None, 9)], "operation_id string, chunk_index int, outcome string, error string, message_id long")
    operations, chunks = ledger.settle(operations, chunks, results, F.lit(NOW))
    assert ledger.sendable(operations, chunks, "me").count() == 0
    operations = ledger.complete(operations, chunks, F.lit(NOW))
    assert {r.operation_id: r.status for r in operations.collect()} == {"o": "failed", "p": "complete"}
    by_hand = spark.createDataFrame([("o", 0, "retry"), ("p", 0, "retry")], "operation_id string, chunk_index int, resolution string")
    operations, chunks = ledger.reconcile(operations, chunks, by_hand, F.lit(NOW))
    assert {(r.operation_id, r.chunk_index): r.status for r in chunks.collect()} == {("o", 0): "pending", ("o", 1): "pending", ("p", 0): "confirmed"}
    assert {r.operation_id: r.status for r in operations.collect()} == {"o": "pending", "p": "complete"}


def test_steps_read_each_table_once(spark):
    """Plans of steps that follow each other don't double: a step's tables stand in its plan once."""
    operations = spark.createDataFrame([("o", "failed", "me", NOW, NOW, None), ("p", "failed", "me", NOW, NOW, None), ("q", "failed", "me", NOW, NOW, None)], ledger.OPERATIONS)
    rows = [("o", 0, "uncertain"), ("o", 1, "confirmed"), ("p", 0, "sending"), ("p", 1, "failed"), ("q", 0, "confirmed"), ("q", 1, "failed")]
    chunks = spark.createDataFrame([(o, i, "b", s, 1, None, None, None) for o, i, s in rows], ledger.CHUNKS)
    by_hand = spark.createDataFrame([("o", 0, "confirmed"), ("p", 0, "retry"), ("q", 0, "retry")], "operation_id string, chunk_index int, resolution string")
    later = NOW + dt.timedelta(minutes=1)
    ready = ledger.sendable(operations, chunks, "me")
    after, settled = ledger.reconcile(operations, chunks, by_hand, F.lit(later))
    assert [(r.operation_id, r.chunk_index) for r in ready.collect()] == [("q", 1)]
    assert {r.operation_id: tuple(r)[1:] for r in after.collect()} == {"o": ("complete", None, None, later, later), "p": ("pending", None, None, later, None), "q": ("failed", "me", NOW, NOW, None)}
    assert {(r.operation_id, r.chunk_index): r.status for r in settled.collect()} == {(o, i): {("o", 0): "confirmed", ("p", 0): "pending"}.get((o, i), s) for o, i, s in rows}
    read = [df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") for df in (ready, after, settled)]
    assert read == [2, 3, 2]


def test_stored_steps_are_not_broadcast(spark, monkeypatch):
    """Every step's joins are merges: files of a stored ledger are far smaller than its rows, which the driver couldn't hold."""
    plans = []
    monkeypatch.setattr(lifecycle, "stored", lambda df, path: plans.append(df) or folders.stored(df, path))
    plans.append(catalog.queries()["ledger_steps"](spark, "/root/testdata/sf0.001"))
    texts = [df._jdf.queryExecution().sparkPlan().toString() for df in plans]
    assert [t.count("SortMergeJoin") for t in texts] == [0, 1, 1, 1, 1, 1, 1, 5]
    assert not any("Broadcast" in t for t in texts)


# --- runs and ids


def test_recent_runs_have_bounds(spark):
    df = spark.createDataFrame([("1", "collect", NOW)], "run_id string, kind string, started_at timestamp")
    for n in (0, 201, -1, 2.5, True, "3"):
        with pytest.raises(ValueError, match="limit"):
            runs.recent_runs(df, "collect", n)
    assert runs.recent_runs(df, "collect", 200).count() == 1


def test_ulids_sort_by_time(spark):
    df = spark.createDataFrame([(0, dt.datetime(2026, 1, 1), "f" * 20), (1, dt.datetime(2026, 1, 2), "0" * 20), (2, dt.datetime(2016, 7, 30, 23, 54, 10, 259000), "0" * 19 + "1")], "i int, ts timestamp, r string")
    got = {r.i: r.u for r in df.select("i", identity.ulid(F.col("ts"), F.col("r")).alias("u")).collect()}
    assert got[0] < got[1] and all(len(u) == 26 for u in got.values())
    assert got[2] == "01ARZ3NDEK" + "0" * 15 + "1"
    assert got[0].endswith("Z" * 16)


def test_summaries(spark):
    row = spark.range(1).select(render.run_summary(F.lit(3), F.lit(2), F.lit(1), F.lit(0), F.array(F.lit("a")), F.array().cast("array<string>")).alias("t"), render.opening_entry(F.lit("A"), F.lit("Dev"), F.lit("2027.1")).alias("o")).first()
    assert row.t == "Resumo da execução\n\nColetadas: 3\nNovas após deduplicação: 2\nApós pré-filtro: 1\nPontuadas: 0\nFontes com falha: a\nFontes truncadas pelo limite: nenhuma"
    assert row.o == "A — Dev\nAbre para você em 2027.1"
    empty = spark.range(1).select(render.study_plan_text(F.lit(0), F.lit(0), F.lit(0), F.lit(None).cast("string"), F.lit(""), F.lit("")).alias("t")).first().t
    assert empty == "Corpus: 0 vagas · 0 com extração completa · 0 de alta compatibilidade\n\n---\n\nLacunas mais frequentes\n\n(nenhuma lacuna identificada)\n\n---\n\nTecnologias mais pedidas no mercado\n\n(sem dados suficientes)\n\n---\n\nVolume por semana\n\n(sem dados)"


def test_words_agree_on_driver_and_executors(spark):
    for t in ("C++ e Node.js", "Ação — ﬁm", " ", "№ 5"):
        assert text.plain_words(t) == spark.range(1).select(text.normalized_words(F.lit(t)).alias("w")).first().w


def test_broken_payloads_are_marked(spark):
    rows = [(1, "known", "Rio", NOW, json.dumps({"a": 1})), (2, "known", None, NOW, "{"), (3, "unknown", "Rio", NOW, None)]
    got = {r.i: r for r in store.hydrated(spark.createDataFrame(rows, "i int, location_kind string, location_city string, last_seen_at timestamp, raw_payload string")).collect()}
    assert [(got[i].location_kind, got[i].location_city, got[i].raw_payload, got[i].collected_at) for i in (1, 2, 3)] == [("known", "Rio", '{"a": 1}', NOW), ("unknown", None, '{"corrupted":true}', NOW), ("unknown", None, None, NOW)]
