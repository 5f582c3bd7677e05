"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def finite(value: Column) -> Column:
    """Null for NaN and for either infinity."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(INFINITY)), value)


def ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """``numerator / denominator * scale``; null on a zero divisor or an infinite result."""
    quotient = F.try_divide(numerator, denominator)
    return finite(quotient * F.lit(scale) if scale != 1.0 else quotient)


def clip(value: Column, low: Column, high: Column) -> Column:
    """Bound a value; nulls stay null."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, high), low))


def round_even(value: str | Column, digits: int) -> Column:
    """Round the scaled value half to even, the way array libraries do.

    ``round`` rounds the decimal digits half up instead; the two differ on exact ties.
    """
    scale = float(10**digits)
    column = F.col(value) if isinstance(value, str) else value
    return F.rint(column * scale) / scale + 0.0  # no negative zero
