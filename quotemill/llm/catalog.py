"""Queries of the operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quotemill.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    language,
    language_model,
    licenses,
    negatives,
    packing,
    pii,
    quality,
    simhash,
    spelling,
    wrappers,
)
from quotemill.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": lambda spark, d: simhash.simhash_dedup(table(spark, d, "documents")),
    "op2_language": lambda spark, d: language.language_id(table(spark, d, "documents")),
    "op3_decontaminate": lambda spark, d: decontaminate.decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op4_wrappers": lambda spark, d: wrappers.main_text(table(spark, d, "pages")),
    "op5_quality": lambda spark, d: quality.quality(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_hidden_markov": lambda spark, d: language_model.score_texts(table(spark, d, "documents")),
    "op7_packing": lambda spark, d: packing.packed(table(spark, d, "documents")),
    "op8_pii": lambda spark, d: pii.find_pii(table(spark, d, "documents")).drop("found"),
    "op9_licenses": lambda spark, d: licenses.scan(table(spark, d, "documents")).drop("matches"),
    "op10_tree_merge": lambda spark, d: exact_dedup.exact_dedup(table(spark, d, "documents")),
    "op11_prefix_bpe": lambda spark, d: bpe.round_trip(table(spark, d, "documents")),
    "op12_spelling": lambda spark, d: spelling.variants(table(spark, d, "documents")),
    "op13_hard_negatives": lambda spark, d: negatives.shifted(table(spark, d, "embeddings")),
}

CHECKS: dict[str, str] = {
    "op10_tree_merge": exact_dedup.EXACT_DEDUP_SQL,
    "op13_hard_negatives": negatives.NEGATIVES_SQL,
}
