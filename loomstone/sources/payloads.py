"""Readers of captured payloads, sitemaps and pages. Nothing here uses the network: sources are files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.text import plain_normalize
from .schemas import ENVELOPES


def read_envelopes(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(source, source_id, payload) of the items in files of one envelope each (an object or a bare array)."""
    at, key = ENVELOPES[source]
    whole = spark.read.option("wholetext", True).text(path)
    items = F.get_json_object("value", f"$.{at}") if at else F.col("value")
    each = whole.select(F.explode(F.from_json(items, "array<string>")).alias("payload"))
    return each.select(F.lit(source).alias("source"), F.get_json_object("payload", f"$.{key}").alias("source_id"), "payload")


def with_id(raw: DataFrame) -> DataFrame:
    """Rows that have an id; the others can't be told apart later."""
    return raw.filter(F.col("source_id").isNotNull())


def capped(raw: DataFrame, query: str, order: str, cap: int) -> DataFrame:
    """The first cap rows of each query, with whether the cap cut it short."""
    from pyspark.sql import Window as W

    w = W.partitionBy(query)
    numbered = raw.withColumns({"__r": F.row_number().over(w.orderBy(order)), "__n": F.count("*").over(w)})
    return numbered.filter(F.col("__r") <= cap).withColumn("truncated", F.col("__n") > cap).drop("__r", "__n")


def ciee_wanted(levels: Sequence[str] = ("SU",), cities: Sequence[str] = (), areas: Sequence[str] = ()) -> Column:
    """The client-side filter of a source that can't filter: level, and city and area as parts of the normalised text."""
    from ..functions.text import normalize

    def named(c: Column, wanted: Sequence[str]) -> Column:
        if not wanted:
            return F.lit(True)
        return F.exists(F.array(*(F.lit(plain_normalize(w)) for w in wanted)), lambda w: F.contains(normalize(F.coalesce(c, F.lit(""))), w))

    level = F.get_json_object("payload", "$.nivelEscolar")
    return level.isin(*levels) & named(F.get_json_object("payload", "$.local.cidade"), cities) & named(F.get_json_object("payload", "$.areaProfissional"), areas)


def unknown_sources(queries: DataFrame, registry: Sequence[str]) -> DataFrame:
    """Queries whose source no reader serves: a recorded failure each."""
    return queries.filter(~F.col("source").isin(*registry)).withColumn("failure", F.concat(F.lit("unknown source: "), F.col("source")))


def sitemap_locations(xml: Column) -> Column:
    """All <loc> URLs of a sitemap."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def candidates(sitemaps: DataFrame, title: str, hosts: Sequence[str], xml: str = "xml") -> DataFrame:
    """(id, url) of the sitemaps' URLs on allowed hosts whose last part matches the title pattern; the id is the number at the end."""
    each = sitemaps.select(F.explode(sitemap_locations(F.col(xml))).alias("url")).filter(url_allowed(F.col("url"), hosts) & F.col("url").rlike(title))
    return each.select(F.regexp_extract("url", r"(\d+)/?$", 1).alias("id"), "url").filter(F.col("id") != "").dropDuplicates(["id"])


def url_allowed(url: Column, hosts: Sequence[str]) -> Column:
    """Whether a URL is https, on one of the hosts, on the default port and without user information."""
    host = F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.regexp_replace(host, ":443$", "").isin(*[h.lower() for h in hosts]), F.lit(False))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def json_ld(html: Column) -> Column:
    """The first JSON-LD script of a page, or null."""
    found = F.trim(F.regexp_extract(html, r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1))
    return F.when(found != "", found)


def links(html: Column) -> Column:
    """Targets of a page's links, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), 1)


def string_array(c: Column) -> Column:
    """A JSON array of strings; malformed text gives an empty one."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def numeric_record(c: Column) -> Column:
    """A JSON object's finite values of 0 or more; malformed text gives an empty map."""
    parsed = F.coalesce(F.from_json(c, "map<string,double>"), F.create_map().cast("map<string,double>"))
    return F.map_filter(parsed, lambda k, v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))


def load_criteria(config: Mapping[str, object]) -> list[str]:
    """Problems of a criteria mapping, each with its path (driver side)."""
    problems = []
    if not config.get("queries"):
        problems.append("queries: at least one")
    for i, q in enumerate(config.get("queries") or []):
        if not isinstance(q, Mapping) or not q.get("source"):
            problems.append(f"queries[{i}].source: missing")
    for name, pattern in dict(config.get("patterns") or {}).items():
        try:
            re.compile(str(pattern))
        except re.error as e:
            problems.append(f"patterns.{name}: {e}")
    return problems
