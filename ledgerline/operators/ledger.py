"""The attempt ledger: one row per attempt to load a ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count_if(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def _outcomes() -> list[Column]:
    return [
        _count_if(F.col("status") == "PASS", "passed"),
        _count_if(F.col("status") == "FAIL", "failed"),
    ]


def ingestion_summary(attempts: DataFrame) -> DataFrame:
    """Requested, passed and failed loads of a run."""
    return attempts.agg(F.count("*").alias("requested"), *_outcomes())


def batch_report(attempts: DataFrame) -> DataFrame:
    """Outcome counts and loaded rows per ticker."""
    return attempts.groupBy("ticker").agg(
        F.count("*").alias("attempts"), *_outcomes(), F.sum("rows").alias("rows")
    )


def batch_totals(attempts: DataFrame) -> DataFrame:
    """Totals of a run and the tickers that failed; the list is as long as the universe at most."""
    failed = F.array_sort(F.collect_set(F.when(F.col("status") == "FAIL", F.col("ticker"))))
    return attempts.agg(
        F.count("*").alias("attempts"), *_outcomes(), F.sum("rows").alias("rows"), F.array_join(failed, ",").alias("failed_tickers")
    )


def current_state(events: DataFrame) -> DataFrame:
    """Latest event per ticker: by ``event_at``, then by ``event_id``."""
    latest = events.groupBy("ticker").agg(
        F.max_by(F.struct("status", "error"), F.struct("event_at", "event_id")).alias("_s"),
        F.max("event_at").alias("event_at"),
    )
    return latest.select("ticker", "_s.*", "event_at")


def checkpoint_stats(state: DataFrame) -> DataFrame:
    """Totals over the current state, and when the last ticker finished."""
    return state.agg(F.count("*").alias("total"), *_outcomes(), F.max("event_at").alias("completed_at"))


def failed_tickers(state: DataFrame) -> DataFrame:
    return state.filter(F.col("status") == "FAIL").select("ticker", "error", "event_at")


def resume_worklist(requested: DataFrame, state: DataFrame, resume: bool = True) -> DataFrame:
    """Requested tickers that have not completed; order by ``position`` to keep request order."""
    if not resume:
        return requested
    done = state.filter(F.col("status") == "PASS").select("ticker")
    return requested.join(done, "ticker", "left_anti")
