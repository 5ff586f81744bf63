"""Scoring of postings end to end: a stub, and the composition of extraction, matching, score and recommendation.

Both give the same columns, with failures as values: ``failure`` is null where a posting was scored.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.identity import bounded_content, requirements_hash
from ..functions.text import normalize, normalize_title
from ..sources.folders import shared_folder
from . import enrich, evidence, scoring
from .prefilter import Criteria, classify_tracks

#: What a scored posting has more than a posting.
SCORED = ("tracks", "score", "verdict", "mandatory_coverage", "desirable_coverage", "alignment", "low_confidence", "blocking_failures", "critical_gaps", "period_gate", "highlights", "missing_terms", "input_truncated", "evidence_rejected", "failure")


def config_from(criteria: Mapping[str, object]) -> scoring.ScoringConfig:
    """The scoring configuration in a criteria mapping (scoring.weights, scoring.thresholds, scoring.trackWeights); absent values are the defaults."""
    own = dict(criteria.get("scoring") or {})
    weights, thresholds = dict(own.get("weights") or {}), dict(own.get("thresholds") or {})
    known = {"mandatory": weights.get("mandatory"), "desirable": weights.get("desirable"), "track": weights.get("track"), "apply": thresholds.get("apply"), "review": thresholds.get("review"), "blocking_cap": own.get("blockingCap"), "unknown_track_cap": own.get("unknownTrackCap"), "min_requirements": own.get("minRequirements"), "track_weights": own.get("trackWeights")}
    return scoring.ScoringConfig(**{k: v for k, v in known.items() if v is not None})


def with_tracks(postings: DataFrame, criteria: Criteria) -> DataFrame:
    """Postings with the tracks that their titles name."""
    return postings.withColumn("tracks", classify_tracks(normalize_title(F.col("title")), normalize(F.col("title")), criteria))


def _finished(scored: DataFrame, columns: list[str]) -> DataFrame:
    strings = "array<string>"
    kinds = {"period_gate": "struct<minimum_period: int, opens_at: string>", "highlights": strings, "missing_terms": strings, "input_truncated": "boolean", "evidence_rejected": "int", "failure": "string"}
    absent = {"highlights": F.array().cast(strings), "missing_terms": F.array().cast(strings), "input_truncated": F.lit(False), "evidence_rejected": F.lit(0)}
    filled = scored.withColumns({c: absent.get(c, F.lit(None)).cast(k) for c, k in kinds.items() if c not in scored.columns})
    return filled.select(*columns, *SCORED)


def stub_scores(postings: DataFrame, criteria: Criteria, config: scoring.ScoringConfig) -> DataFrame:
    """Scores without reading any requirement: by tracks alone, of low confidence, so never to apply."""
    none = F.array().cast(f"array<{scoring.MATCH}>")
    return _finished(scoring.score(with_tracks(postings, criteria).withColumn("matches", none), config).drop("matches"), postings.columns)


@dataclass(frozen=True)
class Models:
    """The two stages' models and what identifies their answers in the caches."""

    extract: Callable[[str, str], dict]
    match: Callable[[dict], dict]
    name: str
    extract_version: str
    match_version: str


@dataclass
class Run:
    """Results of a scoring run: scored postings, rows for the caches, and extracted fields for the postings' table."""

    scored: DataFrame
    extractions: DataFrame
    matches: DataFrame
    partial: DataFrame
    fields: DataFrame


def written(df: DataFrame) -> DataFrame:
    """A frame's rows, as a table in a folder that all executors share."""
    path = shared_folder(df.sparkSession, "answers")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def model_scores(postings: DataFrame, extractions: DataFrame, matches: DataFrame, partial: DataFrame, models: Models, criteria: Criteria, config: scoring.ScoringConfig, profile: evidence.Profile, profile_hash: str, today: dt.date, keep: Callable[[DataFrame], DataFrame] | None = None) -> Run:
    """Score postings: requirements, their matches with admissible evidence only, score, and highlights.

    Models are asked only for what the caches lack, while this is called. keep must hold a frame's rows, so that no model is
    asked twice for one thing; the default writes and rereads them, so that not even a lost executor makes it ask again.
    """
    keep = keep or written
    content = bounded_content(F.col("title"), F.col("description"))
    bounded = with_tracks(postings, criteria).withColumn("__c", content)
    asked = bounded.select("fingerprint", F.col("__c.content_hash").alias("content_hash"), F.col("__c.title").alias("title"), F.col("__c.description").alias("description"))
    known, fresh = enrich.extract(asked, extractions, models.extract, models.extract_version, models.name)
    fresh = keep(fresh)
    none = F.lit(None).cast("string")
    extracted = known.select("fingerprint", "content_hash", "requirements", "seniority", "experience_years", none.alias("failure")).unionByName(fresh.select("fingerprint", "content_hash", "requirements", "seniority", "experience_years", F.when(F.col("failure") != "blank", F.col("failure")).alias("failure")))
    ready = extracted.filter(F.col("failure").isNull()).withColumn("requirements_hash", requirements_hash(F.col("requirements")))
    known_matches, fresh_matches = enrich.match(ready.select("fingerprint", "requirements_hash", "requirements"), matches, partial, models.match, models.match_version, models.name, profile_hash)
    fresh_matches = keep(fresh_matches)
    matched = known_matches.select("fingerprint", "matches", none.alias("failure")).unionByName(fresh_matches.select("fingerprint", "matches", "failure"))
    failed = extracted.filter(F.col("failure").isNotNull()).select("fingerprint", F.lit("extraction_failed").alias("failure")).unionByName(matched.filter(F.col("failure").isNotNull()).select("fingerprint", F.lit("matching_failed").alias("failure")))
    guarded = matched.filter(F.col("failure").isNull()).select("fingerprint", evidence.guard(F.col("matches"), profile, today).alias("g"))
    joined = bounded.withColumn("input_truncated", F.col("__c.truncated")).drop("__c").join(guarded, "fingerprint").withColumns({"matches": F.col("g.matches"), "evidence_rejected": F.col("g.rejected")}).drop("g")
    done = scoring.score(joined, config, F.lit(profile.course_start), F.lit(today))
    done = done.withColumns({"highlights": scoring.highlights(F.col("matches")), "missing_terms": scoring.missing_terms(F.col("matches"), evidence.profile_keywords(profile))}).drop("matches")
    lost = bounded.drop("__c").join(failed, "fingerprint").withColumns({k: v for k, v in scoring.failure_outcome("").items() if k != "failure"})
    requirement = F.array().cast(f"array<{scoring.REQUIREMENT}>")
    lost = lost.withColumns({**{c: F.lit(0.0) for c in ("mandatory_coverage", "desirable_coverage", "alignment")}, "blocking_failures": requirement, "critical_gaps": requirement})
    scored = _finished(done, postings.columns).unionByName(_finished(lost, postings.columns))
    stamp = lambda df, version: df.withColumns({"prompt_version": F.lit(version), "model": F.lit(models.name)})
    new = fresh.filter(F.col("failure").isNull())
    return Run(
        scored,
        stamp(new.drop("failure"), models.extract_version),
        stamp(fresh_matches.filter(F.col("failure").isNull()).select("fingerprint", "requirements_hash", "matches"), models.match_version).withColumn("profile_hash", F.lit(profile_hash)),
        enrich.finished_matches(fresh_matches, models.match_version, models.name, profile_hash),
        extracted.filter(F.col("failure").isNull()).select("fingerprint", "seniority", "experience_years"),
    )


def scorer(kind: str) -> Callable[..., object]:
    """The scorer of a name: stub or api."""
    found = {"stub": stub_scores, "api": model_scores}
    if kind not in found:
        raise ValueError(f"scorer: {kind} is none of {', '.join(found)}")
    return found[kind]


def failure_counts(candidates: DataFrame, scored: DataFrame, reason: str = "failure") -> DataFrame:
    """(reason, n) of postings that weren't scored: by failure, and those never reached in a run that ended early."""
    by_reason = scored.filter(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))
    missed = candidates.join(scored.select("fingerprint"), "fingerprint", "left_anti").agg(F.count("*").alias("n")).filter("n > 0")
    return by_reason.unionByName(missed.select(F.lit("not_attempted_after_run_failure").alias("reason"), "n"))


def delivered(scored: DataFrame, section: str = "section") -> DataFrame:
    """What a digest delivers: recommended and to review; postings that open later aren't delivered yet."""
    part = lambda s: scored.filter(F.col(section) == s)
    return part("recommended").unionByName(part("review"))
