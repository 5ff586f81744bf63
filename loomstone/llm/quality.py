"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text that is better
compressed with the good one is like good text: the difference of the two compressed sizes, over their sum,
is measured in short stretches (where only the dictionary helps) and against the bad dictionary over the
whole text (where repetition within the text helps, which good text has little of). A logistic curve over
these differences, fitted to other labelled rows than the dictionaries, makes a calibrated score of them.

Texts are scored whole. Labels are taken from a bounded sample: at most ``SAMPLE`` rows of each label, those
of the least MD5 of their id, half of them for the dictionaries and half for the curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession

from .linear import fit_logistic, sigmoid
from .scratch import bound_batches

#: Labelled rows of each label that are learned from, at most.
SAMPLE = 4000
#: Bytes of a short stretch; stretches that a row gives to a dictionary; bytes of a dictionary; zstandard's level.
STRETCH, GIVEN, DICTIONARY, LEVEL = 256, 16, 65536, 3
#: A frame's header and end, which tell nothing of the text.
FRAME = 4
#: Bytes compressed at once when a whole text is measured; longer texts are measured in windows of this size.
WINDOW = 1 << 20


def held_out(key: Column) -> Column:
    """Rows that are kept from learning: CRC-32 of the id as text leaves 1 when divided by 3 (null: false)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """Dictionaries (empty: none could be made) and the curve."""

    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    curve: np.ndarray


class Meter:
    """Compressed-size differences of texts."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad = map(self._compressor, (good, bad))

    @staticmethod
    def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if not dictionary:
            return zstandard.ZstdCompressor(**options)
        held = zstandard.ZstdCompressionDict(dictionary)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=held, **options)

    def differences(self, text: str | None) -> tuple[float, float, float]:
        """(good - bad) / (good + bad): in stretches; good in stretches against bad over the whole; both over the whole. 0 for empty texts."""
        raw = (text or "").encode("utf-8", "replace")
        if not raw:
            return 0.0, 0.0, 0.0
        sizes = lambda c, n: sum(len(c.compress(raw[i : i + n])) - FRAME for i in range(0, len(raw), n))
        good, bad, all_good, all_bad = sizes(self.good, STRETCH), sizes(self.bad, STRETCH), sizes(self.good, WINDOW), sizes(self.bad, WINDOW)
        return (good - bad) / (good + bad), (good - all_bad) / (good + all_bad), (all_good - all_bad) / (all_good + all_bad)


def _curved(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The differences, standardised, with their squares and products; far values are pulled in."""
    z = np.clip((x - mean) / scale, -6, 6)
    i, j = np.triu_indices(z.shape[1])
    return np.c_[z, z[:, i] * z[:, j]]


def _dictionary(stretches: list[bytes]) -> bytes:
    """A trained dictionary, or, of too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY, stretches).as_bytes()
    except zstandard.ZstdError:
        return b"".join(stretches)[-DICTIONARY:]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows that aren't held out.

    docs: doc_id, text. labels: doc_id, quality; rows with another label than 0 or 1 or without an id don't count, of
    rows of one id and label one counts, of texts of one id the least. With one label only, or none, every text gets the same score.
    """
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    counts = dict(usable.groupBy("y").count().collect())
    chosen = [(r.doc_id, y, k % 2) for y in (0, 1) for k, r in enumerate(usable.filter(F.col("y") == y).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample).collect())]
    spark = docs.sparkSession
    bound_batches(spark)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, y int, part int")), "doc_id")
    picked = found.groupBy("doc_id", "y", "part").agg(F.min("text").alias("text"))  # of an id's texts the least, so the sample is bounded
    # GIVEN stretches of a text, evenly spread over it
    spread = F.expr(f"transform(sequence(0, {GIVEN - 1}), i -> substring(text, cast(floor(i * greatest(length(text) - {STRETCH}, 0) / {GIVEN - 1}) as int) + 1, {STRETCH}))")
    given = picked.filter("part = 0").select("y", F.array_distinct(spread).alias("s")).collect()
    good, bad = (_dictionary([s.encode() for r in given if r.y == y for s in r.s if s]) for y in (1, 0))

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        meter = Meter(good, bad)
        for part in parts:
            yield pd.DataFrame([(y, *meter.differences(t)) for y, t in zip(part["y"], part["text"], strict=True)], columns=["y", "a", "b", "c"])

    rows = picked.filter("part = 1").select("y", "text").mapInPandas(measured, "y int, a double, b double, c double").toPandas().sort_values(["y", "a", "b", "c"])
    x, y = rows[["a", "b", "c"]].to_numpy(float), rows["y"].to_numpy(float)
    if not len(y):
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        return Model(good, bad, np.zeros(3), np.ones(3), np.r_[np.zeros(9), np.log(share / (1 - share))])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weight = np.where(y == 1, counts.get(1, 0) / max(1, (y == 1).sum()), counts.get(0, 0) / max(1, (y == 0).sum()))
    return Model(good, bad, mean, scale, fit_logistic(_curved(x, mean, scale), y, weight * len(y) / weight.sum()))


def score(text: Column, model: Model) -> Column:
    """Calibrated score (0 to 1) of a text column; null counts as empty, whose differences are 0."""

    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        meter = Meter(model.good, model.bad)
        for part in parts:
            x = np.array([meter.differences(t) for t in part], dtype=float).reshape(-1, 3)
            yield pd.Series(sigmoid(_curved(x, model.mean, model.scale) @ model.curve[:-1] + model.curve[-1]))

    return scores(text)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text of ``documents``: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
