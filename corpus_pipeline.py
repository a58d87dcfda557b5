"""Preparation of `documents` for training: quality rules, n-gram Jaccard join, suffix-array dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept; all but the last
return the columns of docs. Quality rules iterate, so SQL cannot tell the whole and ORACLE_SQL is None;
the tests run every stage and hold it against a plain version of its rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockloom.llm import jaccard_join, packing, pii, quality, suffix_dedup
from stockloom.llm._shared import staged, table


def sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_sound(spark, docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(spark, docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark, docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES = [
    ("quality rules", sound),
    ("n-gram Jaccard join", distinct),
    ("suffix-array dedup", unrepeated),
    ("PII", private),
    ("best-fit packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, "stage")
    return docs
