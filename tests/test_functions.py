from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text
from ledgerline.functions.numeric import clip, ratio
from ledgerline.operators import companies as ops
from ledgerline.operators.quality import normalize_columns


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_safe_tickers(spark):
    values = [" fpt ", "A.B-C_9", "BAD/../X", "", "A B", "'; DROP", "X" * 21, None]
    assert column(spark, values, text.safe_ticker) == ["FPT", "A.B-C_9"] + [None] * 6


@pytest.mark.parametrize(
    "message, code, legacy",
    [
        ("Rate Limit exceeded", "RATE_LIMIT", "RATE_LIMIT"),
        ("Giới hạn API", "RATE_LIMIT", "RATE_LIMIT"),
        ("NO_DATA: provider returned no rows", "NO_DATA", "NO_DATA"),
        ("symbol not found", "INVALID_TICKER", "INVALID_TICKER"),
        ("invalid bad_data", "INVALID_TICKER", "INVALID_TICKER"),
        ("BAD_DATA: missing source columns", "BAD_DATA", "BAD_DATA"),
        ("high_price too low", "SOURCE_ERROR", "BAD_DATA"),
        ("Mã không hợp lệ", "SOURCE_ERROR", "INVALID_TICKER"),
        ("socket closed", "SOURCE_ERROR", "SOURCE_ERROR"),
    ],
)
def test_error_classes(spark, message, code, legacy):
    assert column(spark, [message], text.error_class) == [code]
    assert column(spark, [message], lambda c: text.error_class(c, text.LEGACY_ERROR_CLASSES)) == [legacy]


def test_markets_lists_and_fallbacks(spark):
    assert column(spark, ["hsx", "HNX", "UpcomIndex", "otc"], text.market_name) == ["HOSE", "HNX", "UPCOM", "OTC"]
    assert column(spark, [" fpt, vnm,,FPT , "], text.ticker_list) == [["FPT", "VNM"]]
    assert column(spark, ["", "x", None], lambda c: text.or_else(c, F.lit("d"))) == ["d", "x", "d"]


def test_financial_industries(spark):
    values = ["Ngân hàng", "Banks", "Financial Services", "Quỹ đầu tư", "Thép", None]
    assert column(spark, values, text.is_financial) == [True, True, True, True, False, False]


def test_ratio_and_clip(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (1e308, 1e-10), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [None, 0.25, None, None]
    assert column(spark, [None, -5.0, 5.0, 1.0], lambda c: clip(c, F.lit(0.0), F.lit(2.0)), "double") == [None, 0.0, 2.0, 1.0]


def test_provider_columns_are_required(spark):
    frame = spark.createDataFrame([("2025-01-02", 1.0, 2.0, 0.5, 1.5, 10)], ["time", "open", "high", "low", "close", "volume"])
    assert normalize_columns(frame, "fpt").first()["ticker"] == "FPT"
    with pytest.raises(ValueError, match="BAD_DATA"):
        normalize_columns(frame.drop("close"), "FPT")


def test_given_financial_flag_beats_the_industry(spark):
    rows = spark.createDataFrame(
        [("A", "Banks", False), ("B", "Steel", True), ("C", "Banks", None)], "ticker string, industry string, flag boolean"
    )
    got = {r["ticker"]: (r["is_financial"], r["status"]) for r in ops.classify(rows, "flag").collect()}
    assert got == {"A": (False, "LISTED"), "B": (True, "LISTED"), "C": (True, "LISTED")}


def test_quota_takes_the_first_of_each_market(spark):
    rows = spark.createDataFrame(
        [(i, f"T{i}", "HOSE" if i % 2 else "HNX") for i in range(300)], "position int, ticker string, market string"
    )
    got = ops.market_quota(rows, "position").groupBy("market").agg(F.count("*"), F.max("position")).collect()
    assert {tuple(r) for r in got} == {("HOSE", 70, 139), ("HNX", 20, 38)}
