"""Duplicate handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.raw import LINEAGE


def keep_last(records: DataFrame, keys: list[str], order: str = LINEAGE) -> DataFrame:
    """The last row per key in reading order.

    An aggregate, not a window: partial results keep one row per key and task, so any
    number of copies of one key shrinks before the shuffle.
    """
    return _one_per_key(records, keys, order, F.max_by)


def keep_first(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row per key in reading order."""
    return _one_per_key(records, keys, order, F.min_by)


def _one_per_key(records, keys, order, pick):
    values = [c for c in records.columns if c not in keys and c != order]
    kept = records.groupBy(*keys).agg(pick(F.struct(*values), order).alias("_row"))
    return kept.select(*keys, "_row.*")


def first_rows(df: DataFrame, keys: list[str], order, n: int, out: str) -> DataFrame:
    """First ``n`` rows per key, numbered from 1; ranked on the map side first."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.row_number().over(w).cast("int")).filter(F.col(out) <= n)
