"""The corpus pipeline: each stage reads the stored result of the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.bagminhash import drop_near_duplicates
from ledgerline.llm.common import documents, stored, table
from ledgerline.llm.exact_dedup import drop_duplicates
from ledgerline.llm.mixing import mixed_documents
from ledgerline.llm.packing import pack
from ledgerline.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, calls toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return drop_duplicates(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return drop_near_duplicates(spark, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all copies and their places in sequences."""
    return pack(spark, docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixing),
    ("packing", packing),
]

# Compression lengths, weighted MinHash and iterated fits have no SQL statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
