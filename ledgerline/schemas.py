"""Declared schemas: nothing in the library infers types from data."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE_COLUMNS = ["open_price", "high_price", "low_price", "close_price"]
RECORD_COLUMNS = ["ticker", "trading_date", *PRICE_COLUMNS, "volume"]
INDICATOR_COLUMNS = ["return_pct", "ma20", "rsi_14"]
CURATED_COLUMNS = [*RECORD_COLUMNS, *INDICATOR_COLUMNS]

OHLCV = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("trading_date", T.TimestampNTZType()),
        *[T.StructField(name, T.DoubleType()) for name in PRICE_COLUMNS],
        T.StructField("volume", T.LongType()),
    ]
)

CURATED = T.StructType(
    OHLCV.fields + [T.StructField(name, T.DoubleType()) for name in INDICATOR_COLUMNS]
)

METADATA_FIELDS = [
    "schema_version",
    "access_library",
    "provider",
    "ticker",
    "status",
    "error_code",
    "rows",
    "attempts",
    "requested_at",
    "completed_at",
]

# Raw JSON fields are read as text so that "missing" and "malformed" stay apart.
RAW_RECORD = T.StructType([T.StructField(name, T.StringType()) for name in RECORD_COLUMNS])
RAW_METADATA = T.StructType([T.StructField(name, T.StringType()) for name in METADATA_FIELDS])
RAW_PAYLOADS = T.ArrayType(
    T.StructType(
        [
            T.StructField("metadata", RAW_METADATA),
            T.StructField("records", T.ArrayType(RAW_RECORD)),
        ]
    )
)

UNIVERSE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ["ticker", "name", "market", "sector", "version", "effective_date"]
    ]
)

SOURCE_CSV = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("sample_row", T.IntegerType()),
        T.StructField("time", T.StringType()),
        *[T.StructField(name, T.DoubleType()) for name in ["open", "high", "low", "close"]],
        T.StructField("volume", T.LongType()),
    ]
)
