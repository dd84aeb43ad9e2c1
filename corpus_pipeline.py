"""From raw documents to packed training sequences, by the operators of ``runlake.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; the result is
written as parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from runlake.llm import mixing, near_dedup, packing, quality_classifier, quality_rules
from runlake.llm.common import table, written
from runlake.llm.queries import prepared


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality classifier keeps."""
    prepared(spark)
    return quality_classifier.kept(docs)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules keep."""
    prepared(spark)
    return quality_rules.kept(docs)[0]


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: shingles of five words, similarity 0.8."""
    prepared(spark)
    return near_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document that is taken repeatedly is as many rows."""
    prepared(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences of 2048."""
    prepared(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", classify), ("quality_rules", apply_rules), ("near_dedup", deduplicate), ("source_mix", mix), ("packing", pack),
]

# Label models, trained scorers and near-duplicate classes are beyond SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
