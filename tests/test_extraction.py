"""Checked answers of models in extraction and matching, and requirements as a table function."""

import json

import pyspark.sql.functions as F
import pytest

from loomstone.operators import enrich, model_output, scorer, scoring

GOOD = {"text": "t", "category": "c", "weight": "mandatory"}
CACHE = f"fingerprint string, content_hash string, prompt_version string, model string, requirements array<{scoring.REQUIREMENT}>, seniority string, experience_years int"


@pytest.mark.parametrize(
    "answer",
    [
        {"requirements": [GOOD | {"weight": "urgent"}]},
        {"requirements": [GOOD | {"text": ""}]},
        {"requirements": [GOOD | {"text": "x" * 501}]},
        {"requirements": [GOOD | {"category": "x" * 101}]},
        {"requirements": [GOOD | {"verifiable": "yes"}]},
        {"requirements": [GOOD] * 41},
        {"requirements": [GOOD], "seniority": "guru"},
        {"requirements": [GOOD], "experience_years": -1},
        {"requirements": [GOOD], "experience_years": 1.5},
        {"requirements": "none"},
        {"requirements": [["t"]]},
        {},
        ["t"],
        None,
    ],
)
def test_answers_that_do_not_fit_are_failures(answer):
    asked = []
    assert enrich.extraction(lambda *a: asked.append(a) or answer, "T", "D") == (None, None, None, "invalid_output", enrich.RETRIES)
    assert len(asked) == enrich.RETRIES


def test_answers_that_fit():
    assert enrich.extraction(lambda *a: {"requirements": [GOOD | {"more": 1}] * 40, "seniority": "mid"}, "T", "D") == ([GOOD | {"verifiable": True}] * 40, "mid", None, None, 1)
    assert enrich.extraction(None, "T", " \n") == enrich.extraction(None, None, None) == ([], None, None, "blank", 0)
    answers = iter([{"requirements": 1}, {"requirements": []}])
    assert enrich.extraction(lambda *a: next(answers), "T", "D") == ([], None, None, None, 2)


def test_a_model_of_texts_keeps_to_both_budgets():
    answers = iter([model_output.TransportError("timeout"), "prose", model_output.TransportError("timeout"), json.dumps({"requirements": [GOOD]})])

    def model(prompt):
        got = next(answers)
        if isinstance(got, Exception):
            raise got
        return got

    waits = []
    structured = model_output.asking(model, lambda title, description: title, model_output.EXTRACTION_SCHEMA, sleep=waits.append)
    assert enrich.extraction(structured, "T", "D")[3:] == (None, 4) and len(waits) == 2

    def failing(category):
        def model(prompt):
            raise model_output.TransportError(category)

        return model_output.asking(model, lambda title, description: title, model_output.EXTRACTION_SCHEMA, sleep=waits.append)

    assert enrich.extraction(failing("timeout"), "T", "D")[3:] == ("transport_failed", 4)  # not asked again beyond its own budget
    assert enrich.extraction(failing("authError"), "T", "D")[3:] == ("permanent_error", 1)


def test_bad_answers_spoil_no_other_rows(spark):
    def model(title, description):
        return {"requirements": [GOOD | {"weight": 7}]} if title == "bad" else {"requirements": [GOOD], "experience_years": 2}

    p = spark.createDataFrame([(t, "h", t, "D") for t in ("bad", "x", "y")], "fingerprint string, content_hash string, title string, description string")
    _, fresh = enrich.extract(p, spark.createDataFrame([], CACHE), model, "v", "m")
    assert {r.fingerprint: (r.failure, r.experience_years) for r in fresh.collect()} == {"bad": ("invalid_output", None), "x": (None, 2), "y": (None, 2)}


def test_matches_are_checked(spark):
    requirement = GOOD | {"verifiable": True}
    p = spark.createDataFrame([(a, "h", [requirement | {"text": a}]) for a in ("met", "odd", "long")], f"fingerprint string, requirements_hash string, requirements array<{scoring.REQUIREMENT}>")
    cache = spark.createDataFrame([], f"fingerprint string, requirements_hash string, matches array<{scoring.MATCH}>, prompt_version string, model string, profile_hash string")
    partial = spark.createDataFrame([], f"fingerprint string, requirements_hash string, requirement_index int, match {scoring.MATCH}, prompt_version string, model string, profile_hash string")

    def model(requirement):
        return {"status": "odd" if requirement["text"] == "odd" else "met", "evidence": "e" * (2001 if requirement["text"] == "long" else 5)}

    _, fresh = enrich.match(p, cache, partial, model, "v", "m", "p")
    assert {r.fingerprint: r.failure for r in fresh.collect()} == {"met": None, "odd": "invalid_output", "long": "invalid_output"}


def test_requirements_in_sql(spark):
    def model(title, description):
        return {"requirements": [GOOD | {"text": f"{title}{i}"} for i in range(int(description))], "seniority": "junior"}

    df = spark.createDataFrame([("a", "A", "2"), ("b", "B", "0"), ("c", "C", None), ("d", "D", "no number"), ("a", "A", "1")], "fingerprint string, title string, description string")
    df.createOrReplaceTempView("told")
    spark.udtf.register("requirements", enrich.requirements_table(model))
    rows = spark.sql("SELECT fingerprint, text, seniority, failure, attempts FROM requirements(TABLE(told) PARTITION BY fingerprint)").collect()
    expected = [("a", "A0", "junior", None, 1), ("a", "A0", "junior", None, 1), ("a", "A1", "junior", None, 1), ("b", None, "junior", None, 1), ("c", None, None, "blank", 0), ("d", None, None, "ValueError", 3)]
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert enrich.requirements_of(df.limit(0), model).collect() == []


def test_answers_are_written_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def note(x):
        calls.add(1)
        return x

    kept = scorer.written(spark.range(3).select(F.udf(note, "long")("id").alias("id")))
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in kept.collect()) == [0, 1, 2]
    assert calls.value == 3
