"""Exact ranks and quantiles without sorting a group in one task.

Values are counted per key on the map side, and the distinct ones are range-partitioned by
key and value: into as many ranges as their number asks for, so a range is bounded whatever
a key holds. A rank inside a range plus the totals of the ranges before it is the rank in the
group. The input is read once, by the counting.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.series import running_sums
from ledgerline.session import stored

# Distinct values per range.
RANGE_ROWS = 200_000


def in_ranges(counts: DataFrame, keys: list[str], value: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows in order of key and value, with ``_bin``, the number of their range.

    Equal values may span two ranges: their order among themselves must not matter.
    """
    held = stored(counts.sparkSession, counts, "counted-values")
    ranges = max(1, math.ceil(held.count() / range_rows))
    placed = held.repartitionByRange(ranges, *keys, value).withColumn("_bin", F.spark_partition_id())
    return stored(counts.sparkSession, placed, "ranged-values")


def value_ranks(values: DataFrame, keys: list[str], value: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Distinct values per key with their frequency and the number of rows below them.

    Returns (keys, value, ``n_here``, ``n_before``); nulls do not count.
    """
    present = values.filter(F.col(value).isNotNull())
    counts = present.groupBy(*keys, value).agg(F.count("*").alias("n_here"))
    summed = running_sums(
        in_ranges(counts, keys, value, range_rows), keys, [F.col(value)], "_bin", {"_upto": F.col("n_here")}
    )
    return summed.select(*keys, value, "n_here", (F.col("_upto") - F.col("n_here")).alias("n_before"))


def exact_quantiles(
    values: DataFrame, keys: list[str], value: str, probabilities: list[float], range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Continuous quantiles per key, as (keys, p, quantile); nulls do not count."""
    ranks = value_ranks(values, keys, value, range_rows)
    asked = F.explode(F.array(*[F.lit(p) for p in probabilities])).alias("p")
    totals = ranks.groupBy(*keys).agg(F.sum("n_here").alias("_n")).select(*keys, "_n", asked)
    position = F.col("p") * (F.col("_n") - 1)
    low, high = F.floor(position), F.ceil(position)

    def holds(rank):
        return (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n_here"))

    # Each rank lies in one row: a key sends two rows per quantile and task at most.
    near = ranks.join(totals, keys).filter(holds(low) | holds(high))
    ends = near.groupBy(*keys, "p", "_n").agg(
        F.max(F.when(holds(low), F.col(value))).alias("_a"), F.max(F.when(holds(high), F.col(value))).alias("_b")
    )
    share = position - low
    return ends.select(*keys, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * share).alias("quantile"))
