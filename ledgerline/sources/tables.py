"""Flat CSV sources: company lists and bar samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.quality import normalize_columns
from ledgerline.schemas import SOURCE_CSV, UNIVERSE
from ledgerline.sources.raw import path_order


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Company list with a header line (a byte-order mark in front of it is fine)."""
    universe = spark.read.schema(UNIVERSE).option("header", True).csv(path)
    return universe.withColumn("ticker", F.upper("ticker"))


def in_file_order(table: DataFrame, out: str = "ordinal") -> DataFrame:
    """Add a sort key that follows the order of lines in the files read."""
    return table.select(
        "*",
        F.struct(
            path_order("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias(out),
    )


def first_tickers(universe: DataFrame, n: int, order: str = "ordinal") -> DataFrame:
    """The first ``n`` tickers in list order."""
    return universe.orderBy(order).limit(n).select("ticker")


def read_bar_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample bars under source column names with month/day/year dates."""
    raw = spark.read.schema(SOURCE_CSV).option("header", True).csv(path)
    parsed = raw.withColumn("time", F.to_timestamp_ntz("time", F.lit("M/d/yyyy")))
    return normalize_columns(parsed, F.col("ticker"))
