"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fill_middle, fingerprints, html_text, mixing, near_dedup, pieces, quality, secret_scan, sharding, topk_search, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """name -> callable(spark, sf_dir)."""
    return {
        "op1_source_mixing": mixing.op1_source_mixing,
        "op2_topk_search": topk_search.op2_topk_search,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_bpe": bpe.op4_bpe,
        "op5_html_extraction": html_text.op5_html_extraction,
        "op6_quality": quality.op6_quality,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_sharding": sharding.op10_sharding,
        "op11_sentence_pieces": pieces.op11_sentence_pieces,
        "op12_whitening": whitening.op12_whitening,
        "op13_fill_middle": fill_middle.op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL."""
    return {
        "op2_topk_search": topk_search.ORACLE_SQL,
        "op7_fingerprints": fingerprints.ORACLE_SQL,
        "op8_secret_scan": secret_scan.ORACLE_SQL,
        "op13_fill_middle": fill_middle.ORACLE_SQL,
    }
