"""From documents to packed sequences, in stages that are each written and read again.

quality classifier -> near duplicates -> repeated passages -> mixing to target weights -> packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import dart_minhash, mixing, packing, quality, repeats
from sievework.llm.common import scratch_path, table
from sievework.llm.queries import DOMAIN_SQL, MIX_SEED, MIX_WEIGHTS

BUDGET = 0.9


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels, doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return dart_minhash.deduplicate(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that another document holds as well."""
    return repeats.remove_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, at most once each."""
    return mixing.select_documents(docs, F.expr(DOMAIN_SQL), MIX_WEIGHTS, BUDGET, MIX_SEED)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("near duplicates", without_near_duplicates),
    ("suffix-array dedup", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]
#: Trained dictionaries, MinHash and token ids have no SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
