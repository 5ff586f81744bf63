"""The rule filter: tracks, and the first rule that rejects a posting."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from ..functions.text import matched_keywords, normalize, normalize_title, plain_normalize, title_matches_any

# The rules in the order in which they are tried.
REASONS = ("title_blocked", "title_missing_required_term", "track_unknown", "company_blocked", "expired", "too_old", "location_not_allowed", "insufficient_keyword_adherence")
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Criteria:
    """Rules of the filter; keyword lists are matched as whole words."""

    title_blocklist: Sequence[str] = ()
    title_required: Sequence[str] = ()
    tracks: Mapping[str, Sequence[str]] = field(default_factory=dict)
    track_exclusions: Mapping[str, Sequence[str]] = field(default_factory=dict)
    reject_unknown_track: bool = False
    company_blocklist: Sequence[str] = ()
    max_age_days: float | None = None
    undated_cutover: dt.datetime | None = None
    max_future_skew_days: float = 2
    allow_remote: bool = True
    cities: Sequence[str] = ()
    nationwide_sources: Sequence[str] = ()
    min_keyword_adherence: int = 0

    def __post_init__(self) -> None:
        problems = [f"tracks.{t}: no keywords" for t, k in self.tracks.items() if not k]
        problems += [f"trackExclusions.{t}: no such track" for t in self.track_exclusions if t not in self.tracks]
        if not self.title_required:
            problems.append("titleRequired: at least one term")
        if self.max_age_days is not None and self.max_age_days <= 0:
            problems.append("maxAgeDays: must be positive")
        if problems:
            raise ValueError("; ".join(problems))


def classify_tracks(spaced: Column, collapsed: Column, criteria: Criteria) -> Column:
    """Tracks with a keyword in the title and no exclusion, in the criteria's order."""
    found = []
    for track, keywords in criteria.tracks.items():
        veto = F.size(matched_keywords(spaced, collapsed, criteria.track_exclusions.get(track, ()))) > 0
        found.append(F.when(~veto & (F.size(matched_keywords(spaced, collapsed, keywords)) > 0), F.lit(track)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def future_published(criteria: Criteria, now: Column) -> Column:
    """Whether the publication date lies further ahead than a skew explains."""
    skew = int(criteria.max_future_skew_days * DAY_MS)
    return F.coalesce(F.unix_millis("published_at") - F.unix_millis(now) > skew, F.lit(False))


def too_old(criteria: Criteria, now: Column) -> Column:
    """Whether the posting is past its age, counted from its publication or, if that is missing or implausible, its first sighting."""
    if criteria.max_age_days is None:
        return F.lit(False)
    since = F.when(future_published(criteria, now), F.col("first_seen_at")).otherwise(F.coalesce("published_at", "first_seen_at"))
    old = F.unix_millis(now) - F.unix_millis(since) > int(criteria.max_age_days * DAY_MS)
    if criteria.undated_cutover is None:
        return old
    return (F.col("published_at").isNull() & (F.col("first_seen_at") <= F.lit(criteria.undated_cutover))) | old


def location_allowed(criteria: Criteria) -> Column:
    """Remote by its own rule; an unknown city passes but for nationwide sources; a known one must be listed."""
    cities = sorted({plain_normalize(c) for c in criteria.cities})
    listed = normalize(F.col("location_city")).isin(*cities) if cities else F.lit(False)
    unknown = ~F.col("source").isin(*criteria.nationwide_sources) if criteria.nationwide_sources else F.lit(True)
    return F.when(F.col("work_mode") == "remote", F.lit(criteria.allow_remote)).when(F.col("location_kind") == "unknown", unknown).otherwise(F.coalesce(listed, F.lit(False)))


def prefilter(postings: DataFrame, criteria: Criteria, keywords: Sequence[str], now: dt.datetime) -> DataFrame:
    """Add passed, reason (of the first failing rule), tracks and anomalies.

    One projection, no shuffle. The normalised titles are made first, once for all rules.
    """
    at = F.lit(now)
    spaced, collapsed = F.col("__spaced"), F.col("__collapsed")
    titled = postings.withColumns({"__spaced": normalize_title(F.col("title")), "__collapsed": normalize(F.col("title"))})
    tracked = titled.withColumn("tracks", classify_tracks(spaced, collapsed, criteria))
    companies = sorted({plain_normalize(c) for c in criteria.company_blocklist})
    adherence = sum((F.contains(collapsed, F.lit(plain_normalize(k))).cast("int") for k in keywords), F.lit(0))
    tests = (
        title_matches_any(spaced, criteria.title_blocklist, normalized=True),
        ~title_matches_any(spaced, criteria.title_required, normalized=True),
        F.lit(criteria.reject_unknown_track) & (F.size("tracks") == 0),
        normalize(F.col("company")).isin(*companies) if companies else F.lit(False),
        F.coalesce(F.col("application_deadline") < at, F.lit(False)),
        too_old(criteria, at),
        ~location_allowed(criteria),
        F.lit(criteria.min_keyword_adherence > 0) & (adherence < criteria.min_keyword_adherence),
    )
    reason = F.coalesce(*(F.when(t, F.lit(r)) for t, r in zip(tests, REASONS, strict=True)))
    anomalies = F.when(future_published(criteria, at), F.array(F.lit("published_at_future"))).otherwise(F.array().cast("array<string>"))
    return tracked.withColumns({"reason": reason, "anomalies": anomalies}).withColumn("passed", F.col("reason").isNull()).drop("__spaced", "__collapsed")


def funnel(filtered: DataFrame) -> DataFrame:
    """Postings by reason (``passed`` for those that pass), with their share."""
    counts = filtered.groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))  # over the few counts
    return counts.select("reason", "n", F.round(F.col("n") / total, 6).alias("share"))


def recent_enough(cutoff: Column) -> Column:
    """Collection's recency cut: undated postings and those without a cutoff stay."""
    return cutoff.isNull() | F.col("published_at").isNull() | (F.col("published_at") >= cutoff)
