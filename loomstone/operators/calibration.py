"""Calibration of scores against hand labels."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W


def pearson(x: str, y: str) -> Column:
    """Correlation; null for fewer than two rows or a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    r = F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))
    return F.when(F.count(a) >= 2, r)


def joined(labels: DataFrame, scores: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Labels with their score, and labels without one."""
    return labels.join(scores, key), labels.join(scores, key, "left_anti")


def verdict_metrics(rows: DataFrame, expected: str, actual: str, verdicts: Sequence[str]) -> DataFrame:
    """Support, precision and recall of each verdict over the scored rows (actual not null); null where undefined."""
    scored = rows.filter(F.col(actual).isNotNull())
    stacked = scored.select(F.explode(F.array(*(F.struct(F.lit(v).alias("verdict"), (F.col(expected) == v).alias("e"), (F.col(actual) == v).alias("a")) for v in verdicts))).alias("s")).select("s.*")
    hit = F.count_if(F.col("e") & F.col("a")).cast("double")
    return stacked.groupBy("verdict").agg(F.count_if("e").alias("support"), F.try_divide(hit, F.count_if("a")).alias("precision"), F.try_divide(hit, F.count_if("e")).alias("recall"))


def failure_rate(rows: DataFrame, actual: str) -> DataFrame:
    """Share of rows without a score; 0 on no rows."""
    return rows.agg(F.coalesce(F.try_divide(F.count_if(F.col(actual).isNull()).cast("double"), F.count("*")), F.lit(0.0)).alias("failure_rate"))


def worksheet_batch(candidates: DataFrame, existing: DataFrame, size: int, key: str = "fingerprint", newest: str = "last_seen_at") -> DataFrame:
    """The newest candidates that fill an existing worksheet up to its size."""
    free = size - existing.select(F.count("*")).scalar()
    first = candidates.join(existing.select(key), key, "left_anti").orderBy(F.desc(newest), key).limit(size)
    # numbered among the few that fit an empty worksheet
    numbered = first.withColumn("__k", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(newest), key)))
    return numbered.filter(F.col("__k") <= free).drop("__k")


def probe_table(rows: DataFrame, term: str, passed: Column, on_track: Column) -> DataFrame:
    """For each query term: rows returned, passing and on a track."""
    return rows.groupBy(term).agg(F.count("*").alias("returned"), F.count_if(passed).alias("passes"), F.count_if(on_track).alias("on_track"))
