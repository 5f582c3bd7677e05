"""Raw batches to the curated table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.dedup import keep_last
from ledgerline.operators.indicators import indicators
from ledgerline.operators.quality import accepted_records
from ledgerline.schemas import CURATED_COLUMNS, RECORD_COLUMNS
from ledgerline.session import stored
from ledgerline.sinks.curated import write_curated
from ledgerline.sources.curated import stored_files

KEYS = ["ticker", "trading_date"]


def unique_bars(entries: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Valid records, one per (ticker, trading_date), the last one read."""
    return keep_last(accepted_records(entries, fail_fast), KEYS).select(*RECORD_COLUMNS)


def transform(
    spark: SparkSession, entries: DataFrame, root: str, fail_fast: bool = False
) -> DataFrame:
    """Recompute the curated partitions of every ticker in the input.

    Returns one row: input files, output files, rows and tickers. Rows are counted while the
    table is written; the files are those the input lists and those the write has left in the
    partitions it touched, so no row is read for the summary.
    """
    bars = stored(spark, unique_bars(entries, fail_fast), "bars")
    if bars.isEmpty():
        raise FileNotFoundError("no valid raw records")
    written = Observation("transform")
    curated = indicators(bars).select(*CURATED_COLUMNS).observe(written, F.count("*").alias("rows"))
    write_curated(curated, root, dates=bars)
    out = stored_files(spark, root).join(bars.select("ticker").distinct(), "ticker", "left_semi")
    return out.agg(
        F.lit(len(entries.inputFiles())).cast("bigint").alias("input_files"),
        F.count("*").alias("output_files"),
        F.lit(written.get["rows"]).cast("bigint").alias("rows"),
        F.count_distinct("ticker").alias("tickers"),
    )
