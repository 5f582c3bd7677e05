"""Read the curated layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.schemas import CURATED


def read_curated(spark: SparkSession, root: str, schema=CURATED) -> DataFrame:
    """All tickers; the declared schema keeps tickers text (``001`` is not a number).

    Files that lack a column yield nulls for it, so older and newer files mix by name.
    """
    return spark.read.schema(schema).option("basePath", root).parquet(root).select(*schema.names)


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """ticker, path, length, modified: the files of the layer from its listing; none is opened.

    Spark lists folders in parallel, and of binary files only the columns asked for are read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(root)
    )
    ticker = F.regexp_extract("path", "/ticker=([^/]*)/", 1)
    return files.select(
        # Partition folders escape what paths cannot hold.
        F.url_decode(F.replace(ticker, F.lit("+"), F.lit("%2B"))).alias("ticker"),
        "path",
        "length",
        F.col("modificationTime").alias("modified"),
    )


def inventory_by_ticker(files: DataFrame) -> DataFrame:
    """Number of files per ticker and whether there is anything to serve."""
    counted = files.groupBy("ticker").agg(F.count("*").alias("curated_files"))
    return counted.select("ticker", "curated_files", (F.col("curated_files") > 0).alias("data_ready"))


def inventory(files: DataFrame) -> DataFrame:
    """Number of files of the whole layer and whether there is anything to serve."""
    return inventory_by_ticker(files).agg(
        F.coalesce(F.sum("curated_files"), F.lit(0)).alias("curated_files"),
        (F.count("*") > 0).alias("data_ready"),
    )
