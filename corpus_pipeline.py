"""From documents to packed training sequences: language ID, quality rules, near-duplicate removal, packing.

Each stage takes all rows that its predecessor kept; all but the last return the columns of documents. In all of them a null or
empty text is rejected by the first, a null lang is a stratum of its own, rows of equal or null identifiers stay rows, very long
texts are read whole, an empty table gives no rows, and further columns of any name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import jaccard, langid, packing, quality
from tidewright.llm.common import cut, new_path, release
from tidewright.llm.queries import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined, or has a mean word probability below langid.LEAST_SCORE."""
    return langid.keep_known(docs, langid.train(langid.sample(docs)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or the calibrated cutoffs of their language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    measured = cut(spark, quality.measure(docs), "measured")
    cutoffs = cut(spark, quality.calibrate(measured, labels), "cutoffs")
    release(measured)
    return quality.keep_good(docs, cutoffs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that don't lead their group of near-duplicates."""
    return jaccard.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", known_language), ("quality_rules", good_quality), ("ngram_jaccard_join", one_of_each_group), ("packing", packed)]
#: Training and exact binomial bounds have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
