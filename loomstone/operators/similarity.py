"""Shadow deduplication: similar titles of one company within a time window. Nothing is removed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from ..functions.text import company_group, normalize, significant_title

DAY_MS = 86_400_000
THRESHOLD, WINDOW_DAYS, CAP = 0.35, 14, 500
#: Span of the time buckets in which ranks are counted.
BUCKET_MS = DAY_MS


def ranked(df: DataFrame, key: str, ms: str, order: list[str | Column]) -> DataFrame:
    """Add ``rank``, a row's number (from 0) within its key by the order, of which ms (a long) comes first.

    Rows are numbered within buckets of time, and the buckets' sizes are summed up, so that a key with a large part of
    all rows isn't sorted in one task.
    """
    bucketed = df.withColumn("__bucket", F.floor(F.col(ms) / BUCKET_MS))
    sizes = bucketed.groupBy(key, "__bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(W.partitionBy(key, "__bucket").orderBy(ms, *order)) - 1
    return bucketed.withColumn("__own", own).join(before, [key, "__bucket"]).withColumn("rank", F.col("__before") + F.col("__own")).drop("__bucket", "__own", "__before")


def prepared(postings: DataFrame) -> DataFrame:
    """What comparisons need of a posting: fingerprint, grp, city, ms, the title's significant words, and its rank within the company."""
    base = postings.select(
        "fingerprint",
        company_group(F.col("company")).alias("grp"),
        F.when(F.col("location_kind") == "known", normalize(F.col("location_city"))).alias("city"),
        F.unix_millis("first_seen_at").alias("ms"),
        "pos",
        significant_title(F.col("title")).alias("words"),
    )
    return ranked(base, "grp", "ms", ["pos"])


def bigrams_of(words: str) -> np.ndarray:
    """Bigrams of a string (of one character, itself) as numbers, each with its occurrence number."""
    codes = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    grams = np.sort(codes[:-1] << 21 | codes[1:]) if len(codes) > 1 else codes
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else grams
    return grams << 21 | np.arange(len(grams)) - np.repeat(first, np.diff(np.r_[first, len(grams)]))


def _compared(threshold: float, window_ms: int, cap: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Pairs among the rows of two blocks of ranks of one company and city, by an index from bigrams to rows."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        grams = [bigrams_of(w) for w in rows["words"]]
        sizes = np.array([len(g) for g in grams])
        of, ids = np.unique(np.concatenate(grams), return_inverse=True)
        holders = np.repeat(np.arange(len(rows)), sizes)[np.argsort(ids, kind="stable")]
        ends = np.cumsum(np.bincount(ids, minlength=len(of)))
        starts, stops = np.r_[0, ends[:-1]], np.cumsum(sizes)
        rank, ms, names = rows["rank"].to_numpy(), rows["ms"].to_numpy(), rows["fingerprint"].to_numpy(dtype=object)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(rows["own"].to_numpy()):
            mine = ids[stops[i] - sizes[i] : stops[i]]
            common = np.bincount(np.concatenate([holders[starts[g] : ends[g]] for g in mine]), minlength=len(rows)) if len(mine) else np.zeros(len(rows), int)
            total = sizes + sizes[i]
            similarity = np.where(total == 0, 0.0, 2.0 * common / np.maximum(total, 1))
            near = np.flatnonzero((rank < rank[i]) & (rank[i] - rank <= cap) & (ms[i] - ms <= window_ms) & (similarity >= threshold))
            found.append((np.full(len(near), i), near, similarity[near]))
        later, earlier, alike = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pd.DataFrame({"fingerprint": pd.Series(names[later], dtype=object), "duplicate_of": pd.Series(names[earlier], dtype=object), "similarity": alike, "e_rank": rank[earlier]})

    return compare


def similar_pairs(postings: DataFrame, threshold: float = THRESHOLD, days: float = WINDOW_DAYS, cap: int = CAP) -> DataFrame:
    """All (candidate, earlier, similarity) pairs that qualify.

    Same company group; earlier by at most ``days``, among the newest ``cap`` earlier rows of the company; cities both
    unknown or equal; similarity of at least the threshold. The cap cuts a company into blocks of ranks: a row meets the
    rows of its own and the previous block only, so work is linear in the rows whatever the company's size, and no group
    has more than twice the cap. Within a group, rows meet by an index of bigrams; pairs below the threshold are never
    made into rows.
    """
    rows = prepared(postings).filter(F.col("grp").isNotNull()).withColumn("block", F.floor(F.col("rank") / cap))
    place = lambda block, own: F.struct(block.alias("block"), F.lit(own).alias("own"))
    placed = rows.select("fingerprint", "grp", "city", "ms", "rank", "words", F.explode(F.array(place(F.col("block"), True), place(F.col("block") + 1, False))).alias("p")).select("*", "p.block", "p.own").drop("p")
    return placed.groupBy("grp", "city", "block").applyInPandas(_compared(threshold, int(days * DAY_MS), cap), "fingerprint string, duplicate_of string, similarity double, e_rank long")


def shadow_duplicates(postings: DataFrame, threshold: float = THRESHOLD, days: float = WINDOW_DAYS, cap: int = CAP) -> DataFrame:
    """For each posting with a similar earlier one: the earliest of them, and the similarity to it."""
    first = F.min_by(F.struct("duplicate_of", "similarity"), "e_rank").alias("m")
    return similar_pairs(postings, threshold, days, cap).groupBy("fingerprint").agg(first).select("fingerprint", "m.*")


def truncated_comparisons(postings: DataFrame, days: float = WINDOW_DAYS, cap: int = CAP) -> DataFrame:
    """Number of postings of each company group with more than cap earlier ones within the window."""
    rows = prepared(postings)
    # the cap-th earlier row and one more decide: more than cap lie within the window if that one does
    earlier = rows.select(F.col("grp"), (F.col("rank") + cap + 1).alias("rank"), F.col("ms").alias("e_ms"))
    joined = rows.join(earlier, ["grp", "rank"], "left")
    cut = F.count_if(F.col("ms") - F.col("e_ms") <= int(days * DAY_MS))
    return joined.groupBy("grp").agg(cut.alias("truncated"), F.count("*").alias("n"))
