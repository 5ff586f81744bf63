"""Market analytics over the corpus: demand, gaps and volume."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from ..functions.dates import week_start
from ..functions.text import matched_keywords, normalize, normalize_title


def load_corpus(active: DataFrame, extractions: DataFrame, matches: DataFrame, version: Mapping[str, str], model: str, profile: str) -> DataFrame:
    """Active postings with their requirements and matches, where the caches have them for this version, model, content and profile.

    Two left equi-joins. A posting without requirements looks up its matches by the hash of the empty list.
    """
    from ..functions.identity import requirements_hash

    ext = extractions.filter((F.col("prompt_version") == version["extract"]) & (F.col("model") == model)).select("fingerprint", "content_hash", "requirements")
    got = matches.filter((F.col("prompt_version") == version["match"]) & (F.col("model") == model) & (F.col("profile_hash") == profile)).select("fingerprint", "requirements_hash", "matches")
    with_requirements = active.join(ext, ["fingerprint", "content_hash"], "left")
    none = F.sha2(F.lit("[]"), 256)
    keyed = with_requirements.withColumn("requirements_hash", F.when(F.col("requirements").isNull(), none).otherwise(requirements_hash(F.col("requirements"))))
    return keyed.join(got, ["fingerprint", "requirements_hash"], "left")


def report(postings: DataFrame, matches: DataFrame, extractions: DataFrame) -> DataFrame:
    """Postings that have matches, with their requirements where they have an extraction."""
    return postings.join(matches.select("fingerprint", "matches"), "fingerprint").join(extractions.select("fingerprint", "requirements"), "fingerprint", "left")


def label_counts(postings: DataFrame, label: Column, pos: str = "pos") -> DataFrame:
    """Postings by label (null: unknown), with the first appearance, which breaks ties (``most_first``)."""
    return postings.groupBy(F.coalesce(label, F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"))


def most_first(counts: DataFrame) -> DataFrame:
    """Counted labels, most first, ties by first appearance."""
    return counts.orderBy(F.desc("n"), "first_pos")


def skills_in(text: Column, taxonomy: Mapping[str, Sequence[str]]) -> Column:
    """Canonical skills (in the taxonomy's order) whose name or an alias stands in the text."""
    # bound once, so that the text isn't normalised anew for each skill
    forms = F.array(F.struct(normalize_title(text).alias("spaced"), normalize(text).alias("collapsed")))
    named = lambda f: F.array_compact(F.array(*(F.when(F.size(matched_keywords(f["spaced"], f["collapsed"], [n, *a])) > 0, F.lit(n)) for n, a in taxonomy.items())))
    return F.element_at(F.transform(forms, named), 1)


def skill_mentions(corpus: DataFrame, text: Column, taxonomy: Mapping[str, Sequence[str]]) -> DataFrame:
    """(fingerprint, skill), once for each posting and skill.

    The taxonomy is small, so it is an expression over literals: no theta join with it.
    """
    return corpus.select("fingerprint", F.explode(F.array_distinct(skills_in(text, taxonomy))).alias("skill"))


def skill_frequency(mentions: DataFrame, extracted: int | Column) -> DataFrame:
    """Postings of each skill and their share of the extracted ones (0 where there are none)."""
    count = F.countDistinct("fingerprint")
    return mentions.groupBy("skill").agg(count.alias("n")).withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), F.lit(extracted) if isinstance(extracted, int) else extracted), F.lit(0.0)))


def gap_analysis(mentions: DataFrame, high: DataFrame, profile_skills: Sequence[str]) -> DataFrame:
    """Skills that postings of high compatibility ask for and the profile lacks, with their share of those postings."""
    total = high.select(F.count("*")).scalar()
    asked = mentions.filter(~F.col("skill").isin(*profile_skills)) if profile_skills else mentions
    return skill_frequency(asked.join(high.select("fingerprint").distinct(), "fingerprint", "left_semi"), total)


def weekly_volume(rows: DataFrame, ts: Column) -> DataFrame:
    """Rows by week (its Monday)."""
    return rows.groupBy(week_start(ts).alias("week")).agg(F.count("*").alias("n"))


def top(counts: DataFrame, n: int = 10, by: str = "n", tie: str = "skill") -> DataFrame:
    """The n most frequent."""
    return counts.orderBy(F.desc(by), tie).limit(n)


def corpus_totals(corpus: DataFrame) -> DataFrame:
    """Size of the corpus, and postings with requirements."""
    return corpus.agg(F.count("*").alias("postings"), F.count_if(F.size(F.coalesce("requirements", F.array().cast("array<string>"))) > 0).alias("extracted"))


def study_plan(corpus: DataFrame, text: Column, taxonomy: Mapping[str, Sequence[str]], high: DataFrame, profile_skills: Sequence[str], ts: Column) -> dict[str, DataFrame]:
    """The study plan's parts, each a lazy table over one corpus."""
    mentions = skill_mentions(corpus, text, taxonomy)
    extracted = corpus.select(F.count("*")).scalar()
    return {
        "demand": top(skill_frequency(mentions, extracted)),
        "gaps": top(gap_analysis(mentions, high, profile_skills)),
        "weekly": weekly_volume(corpus, ts).orderBy("week"),
        "companies": most_first(label_counts(corpus, F.col("company"))),
        "regions": most_first(label_counts(corpus, F.col("location_city"))),
        "work_modes": most_first(label_counts(corpus, F.col("work_mode"))),
    }


def rank_within(df: DataFrame, key: str, by: str) -> DataFrame:
    """Rank of each row within its key, highest first."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(by))))
