"""The corpus pipeline: from ``documents`` to token ids, in five stages.

Each stage takes what its predecessor kept and returns the columns of ``documents``, the last one a row of tokens per
document of the mix. Stages are written and read again between each other, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import bpe, mixing, near_dedup, secret_scan, toxicity
from loomstone.llm.scratch import Scratch

#: Most repetitions of a source in the pipeline's mix, in which every document stays once at least.
REPETITIONS = 1.25


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted to ``labels``, doesn't find toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least doc_id."""
    return near_dedup.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced: owner-specific ones and widely copied examples by marks of their own."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of smaller sources repeated in part, up to ``REPETITIONS`` epochs."""
    return mixing.mixed(docs, docs.columns, whole=True, target=None, repetitions=REPETITIONS, added=False)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with their number and the digest of the text that they decode to."""
    return docs.select("doc_id", "lang", "source", bpe.tokenized(spark, F.col("text")).alias("t")).select("doc_id", "lang", "source", "t.*")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("secret_scan", mask_secrets), ("mixing", mix_sources), ("bpe", tokenize)]

#: Classifier, signatures and vocabulary are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
