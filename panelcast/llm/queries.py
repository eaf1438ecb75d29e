"""The operators as queries on the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (bpe, centroids, decontaminate, fingerprint, html_text, ngram_join, prefix_trie, quality, quality_rules,
               token_counts, token_ids, toxicity, warc)
from .common import table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded text of every document."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and copies of every document, five-word grams, 0.8 or more."""
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by both views and together."""
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return token_counts.report(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text, and their likeness."""
    return fingerprint.report(table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, counts and checksums of every document's ids, from the files."""
    return token_ids.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.report(table(spark, sf_dir, "pages"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain counts and likelihood verdict of every document."""
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding."""
    return centroids.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_bpe": op2_bpe,
    "op3_ngram_join": op3_ngram_join,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_counts": op7_token_counts,
    "op8_fingerprint": op8_fingerprint,
    "op9_token_ids": op9_token_ids,
    "op10_html_text": op10_html_text,
    "op11_quality_rules": op11_quality_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_centroids": op13_centroids,
}

SQL: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op3_ngram_join": ngram_join.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
