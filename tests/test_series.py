from __future__ import annotations

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.operators.indicators import (
    adx,
    cci,
    close_ewm,
    indicators,
    indicators_two_decimals,
    macd,
    moving_average,
    technicals,
)
from ledgerline.operators.series import Ewm, Layout, cut, ewm_mean, in_blocks, running_sums

SMALL = Layout(size=100)
LAYOUTS = [Layout(), SMALL]

DAY = dt.datetime(2000, 1, 3)


def bars(spark, closes_by_ticker, step=dt.timedelta(days=1)):
    rows = [
        (t, DAY + i * step, c - 1.0, c + 1.0, c - 2.0, float(c), 1000 + i)
        for t, closes in closes_by_ticker.items()
        for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(
        rows,
        "ticker string, trading_date timestamp_ntz, open_price double, high_price double,"
        " low_price double, close_price double, volume bigint",
    )


def walk(n, seed=1, flat=()):
    rng, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        if not any(a <= i < b for a, b in flat):
            price = max(1.0, round(price + rng.uniform(-2, 2), 2))
        out.append(price)
    return out


def pandas_indicators(closes):
    c = pd.Series(closes)
    delta = c.diff()
    gain = delta.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    loss = (-delta.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    rsi = (100 - 100 / (1 + gain / loss.replace(0, float("nan")))).fillna(100).where(gain.notna())
    return pd.DataFrame(
        {
            "return_pct": c.pct_change(fill_method=None).mul(100),
            "ma20": c.rolling(20, min_periods=1).mean(),
            "rsi_14": rsi,
        }
    )


def by_date(df, ticker, *columns):
    rows = df.filter(F.col("ticker") == ticker).orderBy("trading_date").select(*columns).collect()
    return [tuple(r) if len(columns) > 1 else r[0] for r in rows]


def close_to(got, want, tolerance=6e-5):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        if w is None or (isinstance(w, float) and math.isnan(w)):
            assert g is None
        else:
            assert g == pytest.approx(w, abs=tolerance, rel=1e-9)


def test_golden_rising_closes(spark):
    out = indicators(bars(spark, {"AAA": range(11, 36)}))
    got = by_date(out, "AAA", "return_pct", "ma20", "rsi_14")
    assert got[0] == (None, 11.0, None)
    assert got[13][2] is None and got[14][2] == 100.0
    assert got[-1][1:] == (25.5, 100.0)


def test_golden_two_decimal_variant(spark):
    out = indicators_two_decimals(bars(spark, {"TEST": range(1, 21)}))
    got = by_date(out, "TEST", "return", "ma20", "rsi_14")
    assert got[1][0] == 100.0 and got[19][1] == 10.5 and got[19][2] == 100.0
    flat = indicators_two_decimals(bars(spark, {"FLAT": [5] * 4}))
    assert by_date(flat, "FLAT", "rsi_14") == [None] * 4


def test_long_and_short_series_match_pandas(spark):
    """One ticker holds nearly all rows and spans many blocks; a long flat run in it keeps
    averages alive that a truncated look-back would lose."""
    data = {"HOT": walk(12_000, flat=[(3000, 5500)]), "B": walk(40, 2), "C": walk(1, 3), "D": walk(1025, 4)}
    out = indicators(bars(spark, data)).cache()
    assert out.count() == sum(map(len, data.values()))
    for ticker, closes in data.items():
        want = pandas_indicators(closes)
        for column in want:
            close_to(by_date(out, ticker, column), list(want[column]))
    out.unpersist()


@pytest.mark.parametrize("size", [32, 100, 1024])
def test_block_size_does_not_change_results(spark, size):
    closes = walk(700, 9)
    out = indicators(bars(spark, {"A": closes}), layout=Layout(size=size))
    close_to(by_date(out, "A", "rsi_14"), list(pandas_indicators(closes)["rsi_14"]))
    close_to(by_date(out, "A", "ma20"), list(pandas_indicators(closes)["ma20"]))


@pytest.mark.parametrize("grain", ["year", "month", "day"])
def test_grain_does_not_change_results(spark, grain):
    closes = walk(900, 5)
    layout = Layout(grain=grain, size=128)
    out = indicators(bars(spark, {"A": closes}, dt.timedelta(hours=9)), layout=layout)
    close_to(by_date(out, "A", "rsi_14"), list(pandas_indicators(closes)["rsi_14"]))


@pytest.mark.parametrize("layout", LAYOUTS, ids=lambda x: str(x.size))
def test_cascaded_means_match_pandas(spark, layout):
    closes = walk(2600, 8)
    out = macd(bars(spark, {"A": closes}), layout=layout)
    c = pd.Series(closes)
    line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    close_to(by_date(out, "A", "macd"), list(line))
    close_to(by_date(out, "A", "macd_signal"), list(line.ewm(span=9, adjust=False).mean()))


def test_one_pass_equals_the_single_indicators(spark):
    rows = bars(spark, {"A": walk(2600, 11), "B": walk(30, 12)})
    together = technicals(rows, SMALL).cache()
    singles = {"rsi_14": indicators, "macd": macd, "macd_signal": macd, "adx_14": adx, "cci_14": cci}
    for column, single in singles.items():
        for ticker in "AB":
            close_to(by_date(together, ticker, column), by_date(single(rows), ticker, column), 1.1e-4)
    together.unpersist()


@pytest.mark.parametrize("layout", LAYOUTS, ids=lambda x: str(x.size))
def test_adx_matches_pandas(spark, layout):
    closes = walk(1500, 6)
    frame = pd.DataFrame({"h": [c + 1 for c in closes], "l": [c - 2 for c in closes], "c": closes})
    up, down = frame.h.diff(), -frame.l.diff()
    tr = pd.concat([frame.h - frame.l, (frame.h - frame.c.shift()).abs(), (frame.l - frame.c.shift()).abs()], axis=1).max(axis=1)
    tr[0] = float("nan")
    wilder = dict(alpha=1 / 14, adjust=False, min_periods=14)
    plus = up.where((up > down) & (up > 0), 0.0).where(up.notna()).ewm(**wilder).mean()
    minus = down.where((down > up) & (down > 0), 0.0).where(up.notna()).ewm(**wilder).mean()
    atr = tr.ewm(**wilder).mean()
    pdi, mdi = plus / atr * 100, minus / atr * 100
    dx = ((pdi - mdi).abs() / (pdi + mdi) * 100).where(atr.isna() | (pdi + mdi > 0), 0.0)
    out = adx(bars(spark, {"A": closes}), layout=layout)
    close_to(by_date(out, "A", "adx_14"), list(dx.ewm(**wilder).mean()))


def test_moving_average_over_several_periods(spark):
    closes = walk(2500, 3)
    for periods, layout in [(1, Layout()), (5, SMALL), (50, SMALL), (50, Layout())]:
        out = moving_average(bars(spark, {"A": closes}), periods, layout)
        want = pd.Series(closes).rolling(periods, min_periods=1).mean()
        close_to(by_date(out, "A", f"ma{periods}"), list(want))


def test_ewm_min_periods(spark):
    closes = walk(30, 3)
    out = close_ewm(bars(spark, {"A": closes}), alpha=0.3, min_periods=10)
    want = pd.Series(closes).ewm(alpha=0.3, adjust=False, min_periods=10).mean()
    close_to(by_date(out, "A", "ewm_close"), list(want))


def test_blocks_stay_within_the_double_range(spark):
    closes = walk(1200, 7)
    out = close_ewm(bars(spark, {"A": closes}), alpha=0.9)
    close_to(by_date(out, "A", "ewm_close"), list(pd.Series(closes).ewm(alpha=0.9, adjust=False).mean()))
    rows = bars(spark, {"A": walk(5)})
    pieces = cut(rows, ["ticker"], "trading_date")
    with pytest.raises(ValueError):
        ewm_mean(pieces.rows, pieces, [Ewm("e", "close_price", 0.9)])
    with pytest.raises(ValueError):
        in_blocks(rows, size=10, halo=11)


def test_building_an_indicator_starts_no_job(spark):
    rows = bars(spark, {"A": walk(50), "B": walk(10)})
    spark.sparkContext.setJobGroup("indicators", "none expected")
    try:
        technicals(rows)
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("indicators") == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_running_sums_with_one_hot_key(spark):
    rows = [("hot", i, float(i % 7)) for i in range(3000)] + [("cold", i, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, at int, v double").withColumn(
        "_bin", F.floor(F.col("at") / 100)
    )
    out = running_sums(df, ["k"], [F.col("at")], "_bin", {"s": F.col("v")})
    got = {(r["k"], r["at"]): r["s"] for r in out.collect()}
    total = {"hot": 0.0, "cold": 0.0}
    for k, at, v in rows:
        total[k] += v
        assert got[k, at] == total[k]


def windows(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line]


def test_blocked_plan_orders_rows_per_bin_or_block_only(spark):
    for line in windows(indicators(bars(spark, {"A": walk(30)}))):
        if "close_price" in line or "_gain" in line:
            assert "row_block" in line or "_bin" in line
