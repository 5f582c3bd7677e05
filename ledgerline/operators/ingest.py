"""Provider rows to payload batches: what a collector lands in the raw layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import error_class, safe_ticker
from ledgerline.operators.dedup import keep_first
from ledgerline.operators.quality import check_records, normalize_columns
from ledgerline.schemas import RAW_RECORD, RECORD_COLUMNS

SCHEMA_VERSION = "1.0"


def requested_tickers(requests: DataFrame) -> DataFrame:
    """Requests with safe tickers, each ticker once (its first ``position``).

    An unsafe ticker aborts the job: it must not reach a path or a source.
    """
    checked = safe_ticker(F.col("ticker"))
    message = F.concat(F.lit("invalid ticker: "), F.coalesce("ticker", F.lit("null")))
    cleaned = requests.withColumn("ticker", F.coalesce(checked, F.raise_error(message).cast("string")))
    return keep_first(cleaned, ["ticker"], "position")


def ingest(
    requests: DataFrame, history: DataFrame, provider: str, access_library: str = "files"
) -> DataFrame:
    """One payload per requested ticker and quarter, good ones with their records.

    ``requests``: ticker, position, attempts, message (null when the source answered),
    requested_at, completed_at. ``history``: ticker and the provider's columns. A quarter
    bounds the records of a payload. A ticker without rows yields one NO_DATA payload; a
    payload with a bad record keeps its metadata and drops all of its records.
    """
    bars = normalize_columns(history, F.col("ticker"))
    record = F.struct(*[F.col(c).cast("string").alias(c) for c in RECORD_COLUMNS])
    quarter = F.trunc(F.to_date("trading_date"), "quarter")
    batches = bars.groupBy("ticker", quarter.alias("batch_date")).agg(
        F.array_sort(F.collect_list(F.struct("trading_date", record.alias("r")))).alias("_dated")
    )
    asked = requested_tickers(requests)
    # A failed request has no history worth keeping: one payload tells of the failure.
    answered = asked.filter(F.col("message").isNull()).join(batches, "ticker", "left")
    failed = asked.filter(F.col("message").isNotNull())
    joined = answered.unionByName(failed, allowMissingColumns=True)
    checked = joined.withColumn("_records", F.col("_dated.r")).withColumn(
        "_checked", check_records("_records")
    )
    bad = F.exists("_checked", lambda c: F.size(c["violations"]) > 0)
    code = (
        F.when(F.col("message").isNotNull(), error_class(F.col("message")))
        .when(F.col("_records").isNull(), F.lit("NO_DATA"))
        .when(bad, F.lit("BAD_DATA"))
        .otherwise(F.lit("OK"))
    )
    judged = checked.withColumn("_code", code)
    passed = F.col("_code") == "OK"
    nothing = F.array().cast(f"array<{RAW_RECORD.simpleString()}>")
    return judged.select(
        "batch_date",
        F.struct(
            F.lit(SCHEMA_VERSION).alias("schema_version"),
            F.lit(access_library).alias("access_library"),
            F.lit(provider).alias("provider"),
            "ticker",
            F.when(passed, "PASS").otherwise("FAIL").alias("status"),
            F.col("_code").alias("error_code"),
            F.when(passed, F.size("_records")).otherwise(0).alias("rows"),
            "attempts",
            "requested_at",
            "completed_at",
        ).alias("metadata"),
        F.when(passed, F.col("_records")).otherwise(nothing).alias("records"),
    )
