"""Spark-native analytics over posting-like documents: ingestion, dedup, rules, scoring, market reports."""
