"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models over the words of the whole text; each model
also gets the probabilities of the categories before its own. For training these are out-of-fold predictions, so that a
later model learns how far the earlier ones can be trusted on texts they haven't seen. The features are the presence of
words (lower case) and of word beginnings, which carry over to forms not seen in training; those that tell most of a
category in the training sample are kept, and an L1 penalty leaves few of them in a model.

Models are fitted on a bounded sample of labelled rows: at most ``POSITIVE`` rows with the last category and
``NEGATIVE`` rows without, those of the least MD5 of their id, weighted back to their numbers. Texts are scored whole.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .linear import Incidence, fit_sparse_logistic, sigmoid
from .scratch import Scratch, bound_batches

#: Labelled rows to learn from, at most; features kept for each category; folds; L1 penalty; decision threshold.
POSITIVE, NEGATIVE, FEATURES, FOLDS, LASSO, THRESHOLD = 4000, 8000, 600, 3, 1e-5, 0.5
#: Lengths of word beginnings, and documents of the sample that must have a feature.
BEGINNINGS, LEAST_DOCS = (4, 5, 6), 3
#: Words whose features a worker keeps.
CACHED_WORDS = 100_000
#: The chain of the production query: unusable text first, then toxic text.
CATEGORIES = ("degraded", "toxic")

_word = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text, in lower case."""
    return set(_word.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """A word's features: itself, and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Chain:
    """names: the categories; index: feature to column; coefficients: of each category, the features', the earlier probabilities' and the intercept."""

    names: list[str]
    index: dict[str, int]
    coefficients: list[np.ndarray]


class Reader:
    """Columns of the features that a text has."""

    def __init__(self, index: dict[str, int]) -> None:
        self.index, self.known = index, {}

    def columns(self, text: str | None) -> list[int]:
        known, found = self.known, set()
        if len(known) > CACHED_WORDS:
            known.clear()
        for word in words_of(text):
            own = known.get(word)
            if own is None:
                own = tuple(self.index[f] for f in features_of(word) if f in self.index)
                if len(word) <= 64:
                    known[word] = own
            if own:
                found.update(own)
        return sorted(found)


def _sampled(docs: DataFrame, labels: DataFrame, names: list[str], positive: int, negative: int) -> tuple[DataFrame, dict[int, float]]:
    """Texts of the sampled labelled rows with their categories, one for each id (the least text), and the weight of rows without and with the last category."""
    truth = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(F.col(n).cast("int")).alias(n) for n in names)).dropna()
    last = names[-1]
    counts = {r[last]: r["count"] for r in truth.groupBy(last).count().collect()}
    chosen = [tuple(r) for y, most in ((0, negative), (1, positive)) for r in truth.filter(F.col(last) == y).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(most).collect()]
    spark = docs.sparkSession
    schema = ", ".join(["doc_id long", *(f"{n} int" for n in names)])
    ids = F.broadcast(spark.createDataFrame(chosen, schema))
    weights = {y: n / max(1, sum(1 for c in chosen if c[-1] == y)) for y, n in counts.items()}
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id")
    return found.groupBy("doc_id", *names).agg(F.min("text").alias("text")), weights


def _chosen(found: DataFrame, names: list[str], name: str, fold: int | None, features: int) -> list[str]:
    """The features that tell most of a category, by counts of all rows or of those outside a fold.

    found: feature and, for each fold k, n_k and the number of rows with each category, c_k. That is how far the share of
    the category among rows with the feature is from that among all, in standard errors. The feature "" counts rows.
    """
    kept = [k for k in range(FOLDS) if k != fold]
    of = lambda c: sum((F.col(f"{c}_{k}") for k in kept), F.lit(0))
    counted = found.select("feature", of("n").alias("n"), of(name).alias("y"))
    rows = counted.filter("feature = ''").first()
    if not rows or not 0 < rows.y < rows.n:
        return []
    share = rows.y / rows.n
    gap = F.abs(F.col("y") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)) + 1)
    return [r.feature for r in counted.filter((F.col("n") >= LEAST_DOCS) & (F.col("feature") != "")).orderBy(F.desc(F.round(gap, 9)), "feature").limit(features).collect()]


def fit(docs: DataFrame, labels: DataFrame, names: list[str], positive: int = POSITIVE, negative: int = NEGATIVE) -> Chain:
    """Learn a chain.

    docs: doc_id, text. labels: doc_id and a column of 0 and 1 (or booleans) for each category, in the chain's order; of
    several labels of a row the highest counts, rows with a null one don't; of several texts of an id the least counts. A
    category that all or no rows have gets the same probability everywhere. An out-of-fold probability comes from a model
    whose features were chosen without the fold, too.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample, weights = _sampled(docs, labels, names, positive, negative)
    dealt = sample.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")).repartition(48, F.xxhash64("doc_id", F.lit(1)))  # bounded
    sample = scratch.keep(dealt, "sample")
    kinds = ["n", *names]
    columns = [f"{c}_{k}" for c in kinds for k in range(FOLDS)]

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = {c: Counter() for c in columns}
        for part in parts:
            for row in part.itertuples(index=False):
                own = {"", *(f for w in words_of(row.text) for f in features_of(w))}
                for c in ["n", *(n for n in names if getattr(row, n))]:
                    counts[f"{c}_{row.fold}"].update(own)
        every = sorted(set().union(*counts.values()))
        yield pd.DataFrame({"feature": pd.Series(every, dtype=object)} | {c: np.array([counts[c][f] for f in every], dtype=np.int64) for c in columns}, columns=["feature", *columns])

    schema = ", ".join(["feature string", *(f"{c} long" for c in columns)])
    totals = sample.mapInPandas(counted, schema).groupBy("feature").agg(*(F.sum(c).alias(c) for c in columns))
    found = scratch.keep(totals.filter(sum((F.col(f"n_{k}") for k in range(FOLDS)), F.lit(0)) >= LEAST_DOCS).union(totals.filter("feature = ''")).distinct(), "features")
    index: dict[str, int] = {}

    def numbered(features: list[str]) -> list[int]:
        return [index.setdefault(f, len(index)) for f in features]

    chosen = {(name, None): numbered(_chosen(found, names, name, None, FEATURES)) for name in names}
    chosen |= {(name, k): numbered(_chosen(found, names, name, k, FEATURES)) for name in names[:-1] for k in range(FOLDS)}

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(index)
        for part in parts:
            yield part.drop(columns="text").assign(columns=[reader.columns(t) for t in part["text"]])

    rows = sample.select("doc_id", *names, "fold", "text").mapInPandas(read, ", ".join(["doc_id long", *(f"{n} int" for n in names), "fold int", "columns array<int>"]))
    rows = rows.toPandas().sort_values("doc_id", kind="stable")
    scratch.drop(sample, found)
    x = Incidence([list(c) for c in rows["columns"]], len(index))
    weight = rows[names[-1]].map(weights).to_numpy(float) if len(rows) else np.zeros(0)
    fold = rows["fold"].to_numpy(int)
    # a model of a category may use the features chosen for it and for those before it
    allowed = lambda at, k: sorted({i for n in names[: at + 1] for i in chosen.get((n, k), chosen[n, None])})
    earlier, coefficients = np.zeros((len(rows), 0)), []
    for at, name in enumerate(names):
        y = rows[name].to_numpy(float)
        outside = np.zeros(len(rows))
        if name != names[-1]:
            for k in range(FOLDS):
                rest, own = fold != k, fold == k
                b = fit_sparse_logistic(x.only(allowed(at, k)).take(rest), earlier[rest], y[rest], weight[rest], LASSO)
                outside[own] = sigmoid(_logit(x.take(own), earlier[own], b))
        coefficients.append(fit_sparse_logistic(x.only(allowed(at, None)), earlier, y, weight, LASSO))
        earlier = np.c_[earlier, outside]
    return Chain(names, index, coefficients)


def _logit(x: Incidence, earlier: np.ndarray, b: np.ndarray) -> np.ndarray:
    return x.times(b[: x.width]) + earlier @ b[x.width : -1] + b[-1]


def score(text: Column, chain: Chain) -> Column:
    """A struct of each category's probability for a text column; null counts as empty."""
    used = {f: i for f, i in chain.index.items() if any(b[i] for b in chain.coefficients)}
    width = len(chain.index)

    @F.pandas_udf(", ".join(f"{n} double" for n in chain.names))
    def probabilities(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(used)
        for part in parts:
            x = Incidence([reader.columns(t) for t in part], width)
            earlier = np.zeros((len(part), 0))
            for b in chain.coefficients:
                earlier = np.c_[earlier, sigmoid(_logit(x, earlier, b))]
            yield pd.DataFrame(earlier, columns=chain.names)

    return probabilities(text)


def label_categories(labels: DataFrame) -> DataFrame:
    """The chain's categories from the labels table: doc_id, degraded (quality 0), toxic."""
    return labels.select("doc_id", (1 - F.col("quality").cast("int")).alias("degraded"), F.col("toxic").cast("int").alias("toxic"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with ``p_degraded``, ``p_toxic`` and ``is_toxic`` (0 or 1), which replace columns of these names; rows are kept one to one."""
    chain = fit(docs.select("doc_id", "text"), label_categories(labels), list(CATEGORIES))
    held = f"p_{uuid.uuid4().hex}"  # a name of no column
    p = lambda c: F.col(held)[c]
    scored = docs.withColumn(held, score(F.col("text"), chain))
    return scored.withColumns({"p_degraded": p("degraded"), "p_toxic": p("toxic"), "is_toxic": F.when(p("toxic") >= THRESHOLD, 1).otherwise(0)}).drop(held)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't toxic, with their columns, of whatever names."""
    chain = fit(docs.select("doc_id", "text"), label_categories(labels), list(CATEGORIES))
    bound_batches(docs.sparkSession)
    return docs.filter(score(F.col("text"), chain)["toxic"] < THRESHOLD)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of each category for every text of ``documents``, and whether it is toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
