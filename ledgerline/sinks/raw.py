"""Append payload batches to the raw layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_payloads(
    payloads: DataFrame, root: str, batch_date: str = "batch_date", per_file: int = 2000
) -> None:
    """Append under year=/month=/day=, one payload per line.

    Appending never touches earlier files and the committer publishes a file only when it
    is complete. Rebalancing keeps a crowded day from ending in one task and a quiet one
    from ending in many small files.
    """
    day = F.col(batch_date)
    (
        payloads.select(
            "metadata",
            "records",
            F.date_format(day, "yyyy").alias("year"),
            F.date_format(day, "MM").alias("month"),
            F.date_format(day, "dd").alias("day"),
        )
        .hint("rebalance", F.col("year"), F.col("month"), F.col("day"))
        .write.mode("append")
        .partitionBy("year", "month", "day")
        .option("maxRecordsPerFile", per_file)
        .json(root)
    )
