"""Timestamp rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_MILLIS_FROM = 2e10

# How finely a series is cut into calendar bins before it is ordered.
GRAINS = {
    "year": lambda ts: F.year(ts).cast("long"),
    "month": lambda ts: (F.year(ts) * 12 + F.month(ts)).cast("long"),
    "day": lambda ts: F.unix_date(F.to_date(ts)).cast("long"),
}


def calendar_bin(ts: Column, grain: str = "month") -> Column:
    return GRAINS[grain](ts)


def utc_naive(text: Column) -> Column:
    """ISO text (or an epoch number) to a zone-free UTC timestamp; null if malformed.

    Text without an offset means UTC; text with one is shifted to UTC and then
    loses the zone, so ``2025-01-02T00:00+07:00`` becomes ``2025-01-01 17:00``.
    """
    trimmed = F.trim(text)
    number = trimmed.try_cast("double")
    seconds = F.when(F.abs(number) > EPOCH_MILLIS_FROM, number / 1000).otherwise(number)
    epoch = F.timestamp_micros((seconds * 1_000_000).cast("long"))
    instant = F.when(trimmed.rlike(r"^[+-]?\d+(\.\d+)?$"), epoch).otherwise(
        trimmed.try_cast("timestamp")
    )
    return instant.cast("timestamp_ntz")
