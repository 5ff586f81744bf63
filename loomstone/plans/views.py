"""The postings view of the driver's documents table, and the configuration of the registered queries."""

from __future__ import annotations

import datetime as dt

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions.identity import fingerprint
from ..operators.prefilter import Criteria

NOW = dt.datetime(2024, 2, 1)
CRITERIA = Criteria(
    title_blocklist=("oner", "leaux", "tech lead"),
    title_required=("the", "of", "de", "la", "der", "and", "is", "el"),
    tracks={"dev": ("of", "en", "und", "the-of"), "security": ("with", "by", "que"), "automation": ("for", "die")},
    track_exclusions={"dev": ("on",), "security": ("it",)},
    reject_unknown_track=True,
    company_blocklist=("SRC7", "src-13"),
    max_age_days=30,
    undated_cutover=dt.datetime(2024, 1, 1, 2),
    cities=("EN", "fr", "Es"),
    nationwide_sources=("src3", "src4"),
    min_keyword_adherence=1,
)
KEYWORDS = ("e", "the", "an")
TAXONOMY = {"The": ("thé",), "And/Or": ("and or", "und"), "Of": (), "To": ("a-la", "zu"), "In": ("en",), "Que": ("qui",), "With": ("mit", "avec"), "De la": ()}
PROFILE_SKILLS = ("The", "In")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as postings: the first line up to a full stop is the title, the source the company, the language the city."""
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id").isNotNull())
    i = F.col("doc_id")
    known = i % 7 != 0
    base = docs.select(
        F.concat(F.lit("src"), (i % 5).cast("string")).alias("source"),
        i.cast("string").alias("source_id"),
        F.coalesce("source", F.lit("")).alias("company"),
        F.regexp_extract(F.coalesce("text", F.lit("")), r"^([^.\n]*)", 1).alias("title"),
        F.when(known, "known").otherwise("unknown").alias("location_kind"),
        F.when(known, F.col("lang")).alias("location_city"),
        F.element_at(F.array(*map(F.lit, ("remote", "hybrid", "onsite", "unknown"))), (i % 4 + 1).cast("int")).alias("work_mode"),
        F.when(i % 3 == 0, F.lit(None)).otherwise(F.element_at(F.array(*map(F.lit, ("internship", "junior"))), (i % 2 + 1).cast("int"))).alias("seniority"),
        F.when(i % 11 == 0, F.timestamp_seconds(F.lit(1704067200) + i * 60)).alias("application_deadline"),
        F.when(i % 4 != 1, F.timestamp_seconds(F.lit(1704067200) + i * 600 - 86400 * (i % 5))).alias("published_at"),
        F.col("text").alias("description"),
        F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("first_seen_at"),
        i.alias("pos"),
    )
    return base.withColumn("fingerprint", fingerprint(F.col("company"), F.col("title"), F.col("location_city")))


#: White space, for RE2.
SQL_SPACES = "\\t\\n\\v\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"


def sql_normalize(x: str, mark: str = "") -> str:
    """DuckDB's normalize (or with mark " " normalize_title)."""
    return f"trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}{SQL_SPACES}]', '{mark}', 'g'), '[{SQL_SPACES}]+', ' ', 'g'))"


POSTINGS_SQL = f"""d AS (SELECT * FROM documents WHERE doc_id IS NOT NULL),
p0 AS (SELECT 'src' || (doc_id % 5) AS source, doc_id::VARCHAR AS source_id, coalesce(source, '') AS company, regexp_extract(coalesce(text, ''), '^([^.\\n]*)', 1) AS title,
  CASE WHEN doc_id % 7 <> 0 THEN 'known' ELSE 'unknown' END AS location_kind, CASE WHEN doc_id % 7 <> 0 THEN lang END AS location_city,
  ['remote', 'hybrid', 'onsite', 'unknown'][doc_id % 4 + 1] AS work_mode, CASE WHEN doc_id % 3 <> 0 THEN ['internship', 'junior'][doc_id % 2 + 1] END AS seniority,
  CASE WHEN doc_id % 11 = 0 THEN to_timestamp(1704067200 + doc_id * 60)::TIMESTAMP END AS application_deadline,
  CASE WHEN doc_id % 4 <> 1 THEN to_timestamp(1704067200 + doc_id * 600 - 86400 * (doc_id % 5))::TIMESTAMP END AS published_at, text AS description,
  to_timestamp(1704067200 + doc_id * 60)::TIMESTAMP AS first_seen_at, doc_id AS pos FROM d),
p AS (SELECT *, sha256({sql_normalize("company")} || {sql_normalize("title")} || coalesce({sql_normalize("location_city")}, '')) AS fingerprint, {sql_normalize("title")} AS tc, {sql_normalize("title", " ")} AS ts FROM p0)"""


def sql_keywords(keywords: tuple[str, ...] | list[str], spaced: str = "ts", collapsed: str = "tc") -> str:
    """DuckDB's test whether any keyword stands in a text."""
    from ..functions.text import plain_normalize

    tests = []
    for k in keywords:
        s, c = plain_normalize(k, " "), plain_normalize(k)
        tests.append(f"contains(' ' || {collapsed} || ' ', ' {c} ')")
        if " " in s:
            tests.append(f"contains(' ' || {spaced} || ' ', ' {s} ')")
    return "(" + " OR ".join(tests or ["false"]) + ")"


def sql_terms(terms: tuple[str, ...]) -> str:
    from ..functions.text import plain_normalize

    return "(" + " OR ".join(f"contains(' ' || ts || ' ', ' {plain_normalize(t, ' ')} ')" for t in terms) + ")"
