"""Micro-batch jobs over the raw layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.quality import accepted_records, gate_batches
from ledgerline.operators.series import Layout
from ledgerline.schemas import CURATED_COLUMNS, OHLCV, RECORD_COLUMNS
from ledgerline.sources.raw import LINEAGE, entries_of, unreadable_files
from ledgerline.streaming.incremental import Online, online_batch, read_online
from ledgerline.streaming.versions import Versioned, add, compact, newest

# What a stored bar has besides its ticker, date and close.
EXTRA = tuple((f.name, f.dataType.simpleString()) for f in OHLCV.fields if f.name not in ("ticker", "trading_date", "close_price"))


def raw_stream(
    spark: SparkSession, root: str, files_per_batch: int | None = None, layout: str = "lines"
) -> DataFrame:
    """New raw files as they land, one JSON value per row: a line, or a whole file ("array")."""
    reader = (
        spark.readStream.schema("value string")
        .option("wholetext", layout == "array")
        .format("text")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(root).select(
        F.regexp_replace("value", "^\uFEFF", "").alias("value"),
        F.col("_metadata.file_path").alias("file_path"),
        F.lit(0).alias("root"),
        F.col("_metadata.file_block_start").alias("split_start"),
    )


def curated_tables(out: str) -> Online:
    return Online(out, EXTRA)


def curate_batch(spark: SparkSession, lines: DataFrame, batch_id: int, out: str) -> None:
    """Add one micro-batch to the curated rows.

    Valid records are stored by batch, the last delivery of a bar inside it; the series go on
    from the states of earlier batches, or from the month before the first late bar, so the
    result equals a batch run over all files and a batch in order reads no history. Files of
    which nothing can be read, as an indented array read line by line, are listed under
    ``rejected``.
    """
    entries = entries_of(lines.withColumn("line", F.monotonically_increasing_id()))
    unreadable_files(entries).write.mode("overwrite").parquet(f"{out}/rejected/batch_id={batch_id}")
    records = accepted_records(entries).withColumnRenamed(LINEAGE, "_order")
    online_batch(spark, records.select(*RECORD_COLUMNS, "_order"), batch_id, curated_tables(out), Layout())


def read_curated_stream(spark: SparkSession, out: str) -> DataFrame:
    """The curated rows after all batches so far."""
    return read_online(spark, curated_tables(out)).select(*CURATED_COLUMNS)


def curated_stream_job(
    spark: SparkSession, raw_root: str, out: str, files_per_batch: int | None = None, layout: str = "lines"
) -> None:
    """Process all raw files not seen yet, then stop."""
    (
        raw_stream(spark, raw_root, files_per_batch, layout)
        .writeStream.foreachBatch(lambda df, i: curate_batch(df.sparkSession, df, i, out))
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def ledger_table(out: str) -> Versioned:
    return Versioned(f"{out}/ledger", "ticker string, passed bigint, failed bigint, last_error string", ("ticker",))


def ledger_batch(spark: SparkSession, changed: DataFrame, batch_id: int, out: str) -> None:
    """Store the tickers a batch has changed; earlier versions go when parts are merged."""
    compact(spark, ledger_table(out), batch_id)
    add(ledger_table(out), changed, batch_id)


def ledger_stream_job(
    spark: SparkSession, raw_root: str, out: str, files_per_batch: int | None = None, layout: str = "lines"
) -> DataFrame:
    """Running outcome counts and last error per ticker, kept as streaming state.

    A batch emits and writes the tickers it has changed, no others.
    """
    lines = raw_stream(spark, raw_root, files_per_batch, layout).withColumn("line", F.lit(0).cast("long"))
    gated = gate_batches(entries_of(lines))
    ticker = F.coalesce("metadata.ticker", F.try_element_at("records", F.lit(1))["ticker"])
    failed = F.col("gate_status") == "FAIL"
    finished = F.coalesce("metadata.completed_at", F.lit(""))
    state = gated.groupBy(ticker.alias("ticker")).agg(
        F.count_if(~failed).alias("passed"),
        F.count_if(failed).alias("failed"),
        F.max(F.when(failed, F.struct(finished.alias("at"), F.col("gate_code").alias("code")))).alias("_last"),
    )
    result = state.select(
        "ticker", "passed", "failed", F.coalesce("_last.code", F.lit("OK")).alias("last_error")
    )
    (
        result.writeStream.outputMode("update")
        .foreachBatch(lambda df, i: ledger_batch(df.sparkSession, df, i, out))
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return newest(spark, ledger_table(out))
