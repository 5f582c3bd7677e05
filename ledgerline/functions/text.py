"""Text rules: ticker safety, error classes, market names, financial sectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ticker contract.
SAFE_TICKER = "^[A-Z0-9._-]{1,20}$"

# Error tokens per class, tried from the top.
ERROR_CLASSES = [
    ("RATE_LIMIT", ["rate limit", "ratelimit", "giới hạn api"]),
    ("NO_DATA", ["no data", "emptydata", "no rows"]),
    ("INVALID_TICKER", ["invalid", "not found", "symbol"]),
    ("BAD_DATA", ["bad_data"]),
]
LEGACY_ERROR_CLASSES = [
    ("RATE_LIMIT", ["rate limit", "ratelimit", "giới hạn api"]),
    ("NO_DATA", ["no data", "emptydata", "no rows"]),
    ("INVALID_TICKER", ["invalid", "not found", "không hợp lệ", "symbol"]),
    ("BAD_DATA", ["bad data", "completeness", "missing", "high_price", "low_price"]),
]

# Exchange spellings.
MARKETS = {"HSX": "HOSE", "HOSE": "HOSE", "HNX": "HNX", "UPCOM": "UPCOM", "UPCOMINDEX": "UPCOM"}

# Words that mark a financial industry, in both languages in use.
FINANCIAL_WORDS = ["ngân hàng", "chứng khoán", "bảo hiểm", "tài chính", "quỹ"]
FINANCIAL_WORDS_EN = ["bank", "securities", "insurance", "financ", "fund"]


def clean_ticker(value: Column) -> Column:
    return F.upper(F.trim(value))


def safe_ticker(value: Column) -> Column:
    """The cleaned ticker, or null when it breaks the contract."""
    cleaned = clean_ticker(value)
    return F.when(cleaned.rlike(SAFE_TICKER), cleaned)


def contains_any(value: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [value.contains(word) for word in words])


def error_class(message: Column, classes: list = ERROR_CLASSES) -> Column:
    """First class whose token occurs in the message; a validation error says BAD_DATA."""
    lowered = F.lower(message)
    branches = F
    for name, words in classes:
        branches = branches.when(contains_any(lowered, words), F.lit(name))
    return branches.otherwise(F.lit("SOURCE_ERROR"))


def market_name(value: Column) -> Column:
    upper = F.upper(value)
    mapping = F.create_map(*[F.lit(part) for pair in MARKETS.items() for part in pair])
    return F.coalesce(F.try_element_at(mapping, upper), upper)


def ticker_list(value: Column) -> Column:
    """Comma-separated request text to an ordered list without blanks or repeats."""
    parts = F.transform(F.split(value, ","), clean_ticker)
    return F.array_distinct(F.filter(parts, lambda part: part != ""))


def or_else(*candidates: Column) -> Column:
    """First candidate that is neither null nor empty text."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def is_financial(industry: Column, given: Column | None = None) -> Column:
    words = FINANCIAL_WORDS + FINANCIAL_WORDS_EN
    derived = contains_any(F.lower(F.coalesce(industry, F.lit(""))), words)
    return derived if given is None else F.coalesce(given, derived)
