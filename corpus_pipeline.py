"""The training-data pipeline: language ID, exact dedup, SimHash near-dedup, decontamination, packing.

Every stage works on all rows that its predecessor kept. All but the last return the columns of `documents`; the
last one returns pieces of packed sequences. Rows with null or empty texts have no letters and go in the first stage;
an empty table passes every stage and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quotemill.llm import decontaminate, exact_dedup, language, packing, simhash
from quotemill.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is recognised go."""
    return language.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; the latent space is fitted on the rows of all passages."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), whole=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, as pieces of sequences."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Models, fingerprints and tokens are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result stored before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
