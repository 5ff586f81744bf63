"""Digest sections, message chunks and the delivery ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.identity import chunk_id, operation_id

MESSAGE_LIMIT = 4096
SECTION_BREAK, ENTRY_BREAK = "\n\n\n", "\n\n"


def section_of(verdict: Column, gate: Column, failure: Column | None = None) -> Column:
    """Section of a scored posting: opening_later where a gate holds, recommended, review; null for what isn't shown."""
    failed = F.lit(False) if failure is None else failure.isNotNull()
    return F.when(~failed & gate.isNotNull(), "opening_later").when(failed | (verdict == "review"), "review").when(verdict == "apply", "recommended")


def sections(scored: DataFrame, order: str = "score") -> DataFrame:
    """A row for each section with its entries' text, best first."""
    entries = F.array_sort(F.collect_list(F.struct((-F.col(order)).alias("o"), F.col("pos"), F.col("entry").alias("t"))))
    return scored.filter(F.col("section").isNotNull()).groupBy("section").agg(F.count("*").alias("n"), F.array_join(F.transform(entries, lambda e: e["t"]), ENTRY_BREAK).alias("text"))


def _packed(parts: list[str], joint: str, limit: int) -> list[str]:
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(joint) + len(part) <= limit:
            out[-1] += joint + part
        else:
            out.append(part)
    return [p for p in out if p]


def split_message(text: str, limit: int = MESSAGE_LIMIT) -> list[str]:
    """A text in chunks of at most limit characters: at sections, or else at entries, or else anywhere."""
    if limit < 2:
        raise ValueError("the limit must be 2 at least")
    parts = text.split(SECTION_BREAK)
    if all(len(p) <= limit for p in parts):
        return _packed(parts, SECTION_BREAK, limit)
    entries = [e for p in parts for e in (p.split(ENTRY_BREAK) if len(p) > limit else [p])]
    return _packed([e[i : i + limit] for e in entries for i in range(0, max(1, len(e)), limit)], ENTRY_BREAK, limit)


def chunks(messages: DataFrame, limit: int = MESSAGE_LIMIT) -> DataFrame:
    """(operation_id, chunk_id, chunk_index, content_hash, body). messages: channel, text."""

    @F.pandas_udf("array<string>")
    def split(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([split_message(t or "", limit) for t in part], dtype=object)

    keyed = messages.withColumn("operation_id", operation_id(F.col("channel"), F.sha2("text", 256)))
    each = keyed.select("operation_id", F.posexplode(split("text")).alias("chunk_index", "body"))
    return each.select("operation_id", chunk_id(F.col("operation_id"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", F.sha2("body", 256).alias("content_hash"), "body")
