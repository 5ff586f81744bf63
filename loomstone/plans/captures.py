"""Registered queries over captured pages, and their SQL twins."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..operators.similarity import ranked
from ..sources import captured, sitemaps
from ..sources.folders import shared_folder
from ..sources.schemas import PAGES
from . import catalog
from .views import table

_query = catalog._query
_KINDS = tuple(PAGES)
#: More than any query has, so that all items are read.
_ALL = 2_000_000_000
_SIZES = {k: v.size for k, v in PAGES.items()}


def _captured(spark: SparkSession, sf_dir: str) -> str:
    """Documents as captured pages: a query for each kind of source and source, pages filled in order of the id; some items break the schemas."""
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id").isNotNull())
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (i % 3 + 1).cast("int"))
    title = F.regexp_extract(F.coalesce("text", F.lit("")), r"^([^.\n]*)", 1)
    mode = F.element_at(F.array(*map(F.lit, ("remote", "hybrid", "on-site"))), (i % 7 % 3 + 1).cast("int"))
    gupy = F.to_json(F.struct(i.alias("id"), F.when(i % 11 != 3, title).alias("name"), F.col("lang").alias("city"), mode.alias("workplaceType")))
    # a field of another kind, and a level that isn't wanted
    ciee = F.to_json(F.struct(i.alias("codigoVaga"), F.when(i % 4 != 1, "SU").otherwise("EM").alias("nivelEscolar"), title.alias("areaProfissional"), F.struct(F.when(i % 13 == 4, F.lit("5").cast("string")).otherwise(F.col("lang")).alias("cidade")).alias("local"), F.when(i % 17 == 4, F.lit("x")).alias("atividades")))
    solides = F.to_json(F.struct(i.cast("string").alias("id"), title.alias("title"), F.when(i % 5 != 2, F.struct(F.when(i % 7 != 2, F.col("lang")).alias("name"))).alias("city"), mode.alias("jobType")))
    item = F.when(kind == "gupy", gupy).when(kind == "ciee", ciee).otherwise(solides)
    rows = docs.select(kind.alias("source"), F.coalesce("source", F.lit("none")).alias("query"), (i * 60_000).alias("ms"), item.alias("item")).withColumn("key", F.concat_ws("/", "source", "query"))
    size = F.element_at(F.create_map(*(F.lit(x) for pair in _SIZES.items() for x in pair)), F.col("source"))
    placed = ranked(rows, "key", "ms", ["item"]).withColumn("page", F.floor(F.col("rank") / size).cast("int"))
    listed = placed.groupBy("source", "query", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]), ",").alias("items"))
    whole = F.when(F.col("source") == "gupy", F.concat(F.lit('{"data":['), "items", F.lit("]}"))).when(F.col("source") == "ciee", F.concat(F.lit('{"content":['), "items", F.lit("]}"))).otherwise(F.concat(F.lit('{"data":{"data":['), "items", F.lit("]}}")))
    path = shared_folder(spark, "capture")
    captured.capture(listed.select("source", "query", "page", F.lit(200).alias("status"), whole.alias("body")), path)
    return path


def _read(spark: SparkSession, sf_dir: str, what: str, cap: int | None = _ALL) -> DataFrame:
    captured.register(spark)
    reader = spark.read.format("captured_pages").option("path", _captured(spark, sf_dir)).option("table", what)
    return (reader.option("max_results", str(cap)) if cap is not None else reader).load()


_SCANNED_SQL = """WITH k AS (SELECT doc_id AS i, ['gupy', 'ciee', 'solides'][doc_id % 3 + 1] AS source, coalesce(source, 'none') AS query, lang,
    regexp_extract(coalesce(text, ''), '^([^.\\n]*)', 1) AS t,
  ['remote', 'hybrid', 'on-site'][doc_id % 7 % 3 + 1] AS m FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY source, query ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY source, query) AS n, CASE source WHEN 'ciee'
    THEN 100 ELSE 10 END AS size, CASE source WHEN 'ciee' THEN 6000 ELSE 50 END AS cap FROM k),
j AS (SELECT *, CASE source WHEN 'gupy' THEN CASE WHEN i % 11 = 3 THEN 'name: missing' END
    WHEN 'ciee' THEN CASE WHEN i % 17 = 4 THEN 'atividades: not of kind texts' END
    ELSE CASE WHEN i % 5 <> 2 AND (i % 7 = 2 OR lang IS NULL) THEN 'city.name: missing' END END AS bad,
  source = 'ciee' AND i % 4 = 1 AS unwanted,
  CASE source WHEN 'gupy' THEN lang WHEN 'ciee' THEN CASE WHEN i % 13 = 4 THEN '5' ELSE lang END ELSE CASE WHEN i % 5 <> 2 THEN lang END END AS city,
  CASE WHEN source <> 'ciee' THEN m END AS mode FROM r)"""
_ITEM_SQL = "source, query, (pos // size)::INTEGER AS page, pos, i::VARCHAR AS source_id, t AS title, city, mode"


@_query(f"{_SCANNED_SQL} SELECT {_ITEM_SQL} FROM j WHERE bad IS NULL AND NOT unwanted")
def captured_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of all captured queries that fit their source's schema and filter."""
    return _read(spark, sf_dir, "items").drop("payload")


@_query(f"{_SCANNED_SQL} SELECT {_ITEM_SQL} FROM j WHERE bad IS NULL AND NOT unwanted AND mode = 'remote' AND city IN ('en', 'fr') AND contains(t, 'e')")
def captured_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by mode, city and a part of the title, which the reader filters."""
    items = _read(spark, sf_dir, "items")
    return items.filter((F.col("mode") == "remote") & F.col("city").isin("en", "fr") & F.col("title").contains("e")).drop("payload")


@_query(
    f"{_SCANNED_SQL} SELECT source, query, (pos // size)::INTEGER AS page, pos, CASE WHEN bad IS NOT NULL THEN 'schema' ELSE 'business' END AS kind, "
    f"coalesce(bad, 'level') AS problem FROM j WHERE bad IS NOT NULL OR unwanted"
)
def captured_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that break their source's schema or that its filter refuses, with what is wrong."""
    return _read(spark, sf_dir, "rejects").drop("payload")


@_query(
    f"""{_SCANNED_SQL} SELECT source, query, count(*) FILTER (pos < cap) AS received, count(*) FILTER (pos < cap AND bad IS NULL AND NOT unwanted) AS kept,
    count(*) FILTER (pos < cap AND bad IS NOT NULL) AS schema_rejected,
count(*) FILTER (pos < cap AND bad IS NULL AND unwanted) AS business_rejected, any_value(n) >= any_value(cap) AS truncated, NULL::VARCHAR AS failure FROM j GROUP BY 1, 2"""
)
def captured_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each captured query, scanned up to its source's cap: counters, and whether the cap cut it short."""
    return _read(spark, sf_dir, "scans", None)


_SITE = "https://www.jobs.example/sitemap-"
_HOSTS = ("www.jobs.example",)


@_query(
    f"""WITH RECURSIVE d AS (SELECT DISTINCT doc_id AS i FROM documents WHERE doc_id >= 0), l AS (SELECT i, 10 * i + 1 + k AS j FROM d, range(10) t(k) WHERE i %
    17 <> 3 UNION ALL SELECT i, 3 * i + 2 FROM d UNION ALL SELECT i, i // 4 FROM d),
e AS (SELECT DISTINCT i, j FROM l WHERE j IN (SELECT i FROM d)), r AS (SELECT i, 0 AS depth FROM d WHERE i = 0 UNION SELECT e.j, depth + 1 FROM r JOIN e USING (i) WHERE depth < 12)
SELECT '{_SITE}' || i || '.xml' AS url, min(depth)::INTEGER AS depth FROM r GROUP BY i"""
)
def sitemap_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps that the first one leads to, among files that list each other in cycles, some of them on other hosts."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").filter("doc_id >= 0").select("doc_id").distinct()
    loc = lambda host, n: F.concat(F.lit(f"<loc> {host}/sitemap-"), n.cast("string"), F.lit(".xml</loc>"))
    below = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: loc("https://www.jobs.example", i * 10 + k)), "")
    elsewhere = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: loc("https://jobs.example.net", i * 10 + k)), "")
    xml = F.concat(F.lit("<sitemapindex>"), F.when(i % 17 != 3, below).otherwise(elsewhere), loc("https://www.jobs.example", i * 3 + 2), loc("https://www.jobs.example", F.floor(i / 4)), F.lit("<loc>https://www.jobs.example/vagas/dev/"), i.cast("string"), F.lit("/</loc></sitemapindex>"))
    files = docs.select(F.concat(F.lit(_SITE), i.cast("string"), F.lit(".xml")).alias("url"), xml.alias("xml"))
    return sitemaps.discovered(files, [f"{_SITE}0.xml"], _HOSTS, r"\.xml$")
