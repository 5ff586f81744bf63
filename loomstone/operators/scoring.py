"""Score, verdict, gate and recommendation of a posting from its requirements' matches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.dates import academic_period, period_label
from ..functions.text import minimum_period, plain_normalize, strip_evidence_tag

REQUIREMENT = "struct<text: string, category: string, weight: string, verifiable: boolean>"
MATCH = f"struct<requirement: {REQUIREMENT}, status: string, evidence: string>"


@dataclass(frozen=True)
class ScoringConfig:
    """Weights sum to 100; the threshold of apply lies above that of review."""

    mandatory: float = 35
    desirable: float = 20
    track: float = 45
    apply: float = 70
    review: float = 45
    blocking_cap: float = 35
    unknown_track_cap: float = 50
    min_requirements: int = 3
    track_weights: Mapping[str, float] = field(default_factory=lambda: {"dev": 1.0, "security": 1.0, "automation": 0.7, "unknown": 0.4})

    def __post_init__(self) -> None:
        problems = []
        if abs(self.mandatory + self.desirable + self.track - 100) > 1e-9:
            problems.append("weights: must sum to 100")
        if self.apply <= self.review:
            problems.append("thresholds: apply must be above review")
        if "unknown" not in self.track_weights:
            problems.append("trackWeights.unknown: missing")
        if problems:
            raise ValueError("; ".join(problems))


def make_match(requirement: Column, status: Column, evidence: Column) -> Column:
    """A match; without evidence it is not met."""
    return F.struct(requirement.alias("requirement"), F.when(evidence.isNull(), F.lit("not_met")).otherwise(status).alias("status"), evidence.alias("evidence"))


def valid_matches(matches: Column) -> Column:
    """Whether every match has known values, texts within bounds, and no evidence only where not met."""
    return F.forall(
        matches,
        lambda m: m["status"].isin("met", "partial", "not_met")
        & m["requirement"]["weight"].isin("blocking", "mandatory", "desirable")
        & F.length(m["requirement"]["text"]).between(1, 500)
        & F.length(m["requirement"]["category"]).between(1, 100)
        & F.when(m["evidence"].isNull(), m["status"] == "not_met").otherwise(F.length(m["evidence"]).between(1, 2000)),
    )


def verifiable(matches: Column) -> Column:
    """Matches of requirements that can be verified; an absent mark means so."""
    return F.filter(matches, lambda m: F.coalesce(m["requirement"]["verifiable"], F.lit(True)))


def status_weight(status: Column) -> Column:
    return F.when(status == "met", 1.0).when(status == "partial", 0.5).otherwise(0.0)


def coverage(checked: Column, weight: str) -> Column:
    """Mean status of the (verifiable) matches of a weight; 1 where there are none."""
    own = F.filter(checked, lambda m: m["requirement"]["weight"] == weight)
    total = F.aggregate(own, F.lit(0.0), lambda s, m: s + status_weight(m["status"]))
    return F.coalesce(F.try_divide(total, F.size(own)), F.lit(1.0))


def track_alignment(tracks: Column, weights: Mapping[str, float]) -> Column:
    """The highest weight of the tracks; that of unknown without any."""
    table = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))
    best = F.array_max(F.transform(tracks, lambda t: F.try_element_at(table, t)))
    return F.when(F.size(tracks) > 0, best).otherwise(F.lit(float(weights["unknown"])))


def verdict_of(score: Column, config: ScoringConfig) -> Column:
    return F.when(score >= config.apply, "apply").when(score >= config.review, "review").otherwise("discard")


def score(postings: DataFrame, config: ScoringConfig, course_start: Column | None = None, today: Column | None = None) -> DataFrame:
    """Add mandatory_coverage, desirable_coverage, alignment, raw_score, score, low_confidence, verdict, blocking_failures, critical_gaps and, with a course, period_gate.

    postings: matches (array of ``MATCH``, null as empty) and tracks. A blocking requirement not fully met, and a posting
    without tracks, cap the score; few verifiable matches keep it from apply.
    """
    checked = F.col("__checked")
    out = postings.withColumn("__checked", verifiable(F.coalesce("matches", F.array().cast(f"array<{MATCH}>"))))
    out = out.withColumns({"mandatory_coverage": coverage(checked, "mandatory"), "desirable_coverage": coverage(checked, "desirable"), "alignment": track_alignment(F.col("tracks"), config.track_weights)})
    out = out.withColumn("raw_score", config.mandatory * F.col("mandatory_coverage") + config.desirable * F.col("desirable_coverage") + config.track * F.col("alignment"))
    unmet = lambda *weights: F.transform(F.filter(checked, lambda m: m["requirement"]["weight"].isin(*weights) & (m["status"] != "met")), lambda m: m["requirement"])
    out = out.withColumns({"blocking_failures": unmet("blocking"), "critical_gaps": unmet("mandatory", "blocking")})
    capped = F.when(F.size("blocking_failures") > 0, F.least("raw_score", F.lit(float(config.blocking_cap)))).otherwise(F.col("raw_score"))
    capped = F.when(F.size("tracks") == 0, F.least(capped, F.lit(float(config.unknown_track_cap)))).otherwise(capped)
    out = out.withColumns({"score": F.least(F.lit(100.0), F.greatest(F.lit(0.0), capped)), "low_confidence": F.size(checked) < config.min_requirements})
    verdict = verdict_of(F.col("score"), config)
    out = out.withColumn("verdict", F.when(F.col("low_confidence") & (verdict == "apply"), "review").otherwise(verdict))
    if course_start is not None and today is not None:
        out = out.withColumn("period_gate", period_gate(F.col("blocking_failures"), F.col("raw_score") >= config.review, course_start, today))
    return out.drop("__checked")


def period_gate(failures: Column, worth: Column, course_start: Column, today: Column) -> Column:
    """Struct of the least period and its label where one blocking failure names a semester that is still to come; else null."""
    period = academic_period(course_start, today)
    least = minimum_period(F.try_element_at(failures, F.lit(1))["text"])
    now = F.when(period["status"] == "not_started", 0).otherwise(period["period"])
    ahead = worth & (F.size(failures) == 1) & least.isNotNull() & (period["status"] != "completed") & (now < least)
    return F.when(ahead, F.struct(least.alias("minimum_period"), period_label(course_start, least).alias("opens_at")))


def failure_outcome(reason: str) -> dict[str, Column]:
    """Columns of a posting whose scoring failed: score 0, to review, of low confidence since nothing was judged."""
    return {"score": F.lit(0.0), "verdict": F.lit("review"), "low_confidence": F.lit(True), "failure": F.lit(reason)}


def matched_competencies(matches: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, competency) of met matches whose evidence is a known quote of the profile; of repeated quotes the last counts.

    matches: id, status, evidence. evidence: quote, competency, ord.
    """
    known = evidence.groupBy(strip_evidence_tag(F.col("quote")).alias("q")).agg(F.max_by("competency", "ord").alias("competency"))
    met = matches.filter((F.col("status") != "not_met") & F.col("evidence").isNotNull()).select("id", strip_evidence_tag(F.col("evidence")).alias("q"))
    return met.join(known, "q").select("id", "competency").distinct()


def recommend_variant(matched: DataFrame, variants: DataFrame) -> DataFrame:
    """For each id the first variant with the most matched competencies, of those with any.

    matched: id, competency, which may repeat. variants: variant, ord, competency; a few, of one profile. Their competencies
    are numbered, and an id's shuffle and memory is one row of bits, a word for each 64 (these are counted when called).
    """
    words = range(-(-max(1, variants.select(F.count_distinct("competency")).first()[0]) // 64))
    codes = F.broadcast(variants.select(F.array_sort(F.collect_set("competency")).alias("all")).select(F.posexplode("all").alias("code", "competency")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("code") % 64)
    bits = F.array(*(F.coalesce(F.bit_or(F.when(F.floor(F.col("code") / 64) == w, bit)), F.lit(0).cast("long")) for w in words))
    masks = variants.join(codes, "competency").groupBy("variant", "ord").agg(bits.alias("bits"))
    every = masks.select(F.collect_list(F.struct("variant", "ord", "bits")).alias("every"))
    held = matched.join(codes, "competency").groupBy("id").agg(bits.alias("held")).crossJoin(F.broadcast(every))
    common = lambda v: sum((F.bit_count(F.get("held", F.lit(w)).bitwiseAND(F.get(v["bits"], F.lit(w)))) for w in words), F.lit(0)).cast("long")
    best = F.array_max(F.transform("every", lambda v: F.struct(common(v).alias("overlap"), (-v["ord"]).alias("o"), v["variant"].alias("variant"))))
    return held.select("id", best.alias("b")).select("id", "b.variant", "b.overlap")


def highlights(matches: Column) -> Column:
    """Distinct evidence of met requirements that are more than desirable, in order."""
    met = F.filter(matches, lambda m: (m["status"] == "met") & (m["requirement"]["weight"] != "desirable") & m["evidence"].isNotNull())
    return F.array_distinct(F.transform(met, lambda m: strip_evidence_tag(m["evidence"])))


def missing_terms(matches: Column, keywords: Sequence[str]) -> Column:
    """Texts of requirements at least partly met that name none of the profile's keywords."""
    from ..functions.text import normalize

    needles = F.array(*(F.lit(plain_normalize(k)) for k in keywords)) if keywords else F.array().cast("array<string>")
    open_ = F.filter(matches, lambda m: (m["status"] != "not_met") & ~F.exists(needles, lambda k: F.contains(normalize(m["requirement"]["text"]), k)))
    return F.transform(open_, lambda m: m["requirement"]["text"])
