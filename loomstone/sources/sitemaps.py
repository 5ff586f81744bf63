"""Sitemap discovery to any depth over captured index files: breadth first, each file once, whatever cycles the links make."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .folders import shared_folder
from .payloads import sitemap_locations, url_allowed

#: Levels after which discovery is taken to have gone wrong.
MOST_LEVELS = 1000


def locations(sitemaps: DataFrame, hosts: Sequence[str], url: str = "url", xml: str = "xml") -> DataFrame:
    """(url, location, allowed) of every location in every file, and whether it is on one of the hosts; others must never be opened."""
    each = sitemaps.select(F.col(url).alias("url"), F.explode(sitemap_locations(F.col(xml))).alias("location"))
    return each.withColumn("allowed", url_allowed(F.col("location"), hosts))


def discovered(sitemaps: DataFrame, roots: Sequence[str], hosts: Sequence[str], entry: str = "", url: str = "url", xml: str = "xml", most: int = MOST_LEVELS) -> DataFrame:
    """(url, depth) of the captured files that the roots lead to, with the fewest steps. entry: a pattern that links to files must match.

    Only links between captured files are followed, so the pages that a file lists don't take part. A level is a join of
    the links with the level before, without what has been seen; it is written, so that no later level computes it again.
    """
    spark = sitemaps.sparkSession
    folder = shared_folder(spark, "sitemaps")
    known = sitemaps.select(F.col(url).alias("location")).filter("location is not null").distinct()
    followed = locations(sitemaps, hosts, url, xml).filter(F.col("allowed") & F.col("location").rlike(entry)).select("url", "location").distinct()
    followed.join(known, "location", "left_semi").write.parquet(f"{folder}/links")
    links = spark.read.parquet(f"{folder}/links")
    first = known.filter(F.col("location").isin(list(roots)) & url_allowed(F.col("location"), hosts)).select(F.col("location").alias("url"))
    first.write.parquet(f"{folder}/levels/depth=0")
    schema = "url string, depth int"
    for depth in range(1, most + 1):
        level = spark.read.parquet(f"{folder}/levels/depth={depth - 1}")
        if level.isEmpty():
            return spark.read.schema(schema).option("basePath", f"{folder}/levels").parquet(f"{folder}/levels")
        seen = spark.read.schema(schema).option("basePath", f"{folder}/levels").parquet(f"{folder}/levels").select("url")
        found = links.join(level, "url", "left_semi").select(F.col("location").alias("url")).distinct()
        found.join(seen, "url", "left_anti").write.parquet(f"{folder}/levels/depth={depth}")
    raise ValueError(f"sitemaps are deeper than {most} levels")


def discovered_candidates(sitemaps: DataFrame, roots: Sequence[str], hosts: Sequence[str], title: str, entry: str = "", posting: str = r"/(\d+)/?$") -> tuple[DataFrame, DataFrame]:
    """((id, url) of the postings listed in discovered files, whose URLs match the title; (url, location) of locations refused for their host)."""
    reached = discovered(sitemaps, roots, hosts, entry)
    listed = locations(sitemaps.join(reached.select("url"), "url", "left_semi"), hosts)
    fits = listed.filter(F.col("allowed") & F.col("location").rlike(title)).select(F.regexp_extract("location", posting, 1).alias("id"), F.col("location").alias("url"))
    refused = listed.filter(~F.col("allowed")).select("url", "location").distinct()
    return fits.filter("id <> ''").groupBy("id").agg(F.min("url").alias("url")), refused
