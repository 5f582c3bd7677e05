"""Technical indicators of daily bars. Input key: (ticker, trading_date), unique.

Bars may be read up to three times (bin totals, block totals, rows): pass
a stored table rather than an expensive plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numeric import ratio, round_even
from ledgerline.operators import series
from ledgerline.operators.series import (
    HALO,
    INDEX,
    Cut,
    Ewm,
    Layout,
    block_window,
    ewm_mean,
    fitting,
)

KEYS = ["ticker"]


def cut_bars(bars: DataFrame, layout: Layout = Layout(), **options) -> Cut:
    return series.cut(bars, KEYS, "trading_date", layout, **options)


def _finish(rows: DataFrame, bars: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Input columns plus the results, without the rows repeated for look-back."""
    return rows.filter(~F.col(HALO)).select(
        *bars.columns, *[e.alias(n) for n, e in columns.items()]
    )


def _percent_change() -> Column:
    return (F.try_divide("close_price", "_prev") - 1) * 100


def _with_moves(rows: DataFrame) -> DataFrame:
    change = F.col("close_price") - F.col("_prev")
    return rows.select(
        "*",
        _percent_change().alias("_return"),
        F.greatest(change, F.lit(0.0)).alias("_gain"),
        F.greatest(-change, F.lit(0.0)).alias("_loss"),
    )


def _rolling_close(periods: int) -> Column:
    return F.avg("close_price").over(block_window(KEYS, periods - 1))


def numbered_bars(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Bars with their position in the ticker's series, from 0."""
    return cut_bars(bars, layout).source


def returns(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Percent change to the previous bar."""
    source = cut_bars(bars, layout, lags={"_prev": "close_price"}).source
    return source.select(*bars.columns, round_even(_percent_change(), 4).alias("return_pct"))


def moving_average(bars: DataFrame, periods: int = 20, layout: Layout = Layout()) -> DataFrame:
    """Mean of the last ``periods`` closes, from the first bar on."""
    rows = cut_bars(bars, layout, halo=periods - 1).rows
    out = f"ma{periods}"
    averaged = rows.withColumn(out, _rolling_close(periods))
    return _finish(averaged, bars, {out: round_even(out, 4)})


def close_ewm(
    bars: DataFrame, alpha: float, min_periods: int = 1, layout: Layout = Layout()
) -> DataFrame:
    """Unadjusted exponential mean of the close."""
    pieces = cut_bars(bars, fitting(layout, [alpha]))
    spec = Ewm("_ewm", "close_price", alpha, 0, min_periods)
    return _finish(ewm_mean(pieces.rows, pieces, [spec]), bars, {"ewm_close": round_even("_ewm", 4)})


def _smoothed(bars: DataFrame, periods: int, min_periods: int, layout: Layout) -> DataFrame:
    """Bars with return, 20-bar mean and smoothed gains and losses, not yet rounded."""
    pieces = cut_bars(
        bars,
        fitting(layout, [1 / periods]),
        halo=19,
        lags={"_prev": "close_price"},
        derive=_with_moves,
    )
    specs = [
        Ewm("_avg_gain", "_gain", 1 / periods, 1, min_periods),
        Ewm("_avg_loss", "_loss", 1 / periods, 1, min_periods),
    ]
    return ewm_mean(pieces.rows.withColumn("_ma20", _rolling_close(20)), pieces, specs)


def _rsi(rs: Column) -> Column:
    return 100 - F.lit(100.0) / (1 + rs)


def indicators(bars: DataFrame, periods: int = 14, layout: Layout = Layout()) -> DataFrame:
    """``return_pct``, ``ma20`` and ``rsi_14`` in one pass, four decimals.

    RSI: Wilder smoothing, null for the first 14 bars, 100 where the average loss is zero.
    """
    gain, loss = F.col("_avg_gain"), F.col("_avg_loss")
    rsi = F.when(gain.isNotNull(), F.coalesce(_rsi(F.try_divide(gain, loss)), F.lit(100.0)))
    return _finish(
        _smoothed(bars, periods, periods, layout),
        bars,
        {
            "return_pct": round_even("_return", 4),
            "ma20": round_even("_ma20", 4),
            "rsi_14": round_even(rsi, 4),
        },
    )


def indicators_two_decimals(
    bars: DataFrame, periods: int = 14, layout: Layout = Layout()
) -> DataFrame:
    """The older variant: two decimals, RSI from the second bar, null while nothing moved."""
    gain, loss = F.col("_avg_gain"), F.col("_avg_loss")
    rsi = F.when((loss == 0) & (gain > 0), F.lit(100.0)).otherwise(_rsi(F.try_divide(gain, loss)))
    return _finish(
        _smoothed(bars, periods, 1, layout),
        bars,
        {"return": round_even("_return", 2), "ma20": round_even("_ma20", 2), "rsi_14": round_even(rsi, 2)},
    )


def macd(
    bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, layout: Layout = Layout()
) -> DataFrame:
    """Difference of a fast and a slow exponential mean, and its own exponential mean."""
    alphas = [2 / (n + 1) for n in (fast, slow, signal)]
    pieces = cut_bars(bars, fitting(layout, alphas))
    specs = [Ewm("_fast", "close_price", alphas[0]), Ewm("_slow", "close_price", alphas[1])]
    means = ewm_mean(pieces.rows, pieces, specs)
    line = means.withColumn("_macd", F.col("_fast") - F.col("_slow"))
    lined = ewm_mean(line, pieces, [Ewm("_signal", "_macd", alphas[2])], from_source=False)
    return _finish(
        lined, bars, {"macd": round_even("_macd", 4), "macd_signal": round_even("_signal", 4)}
    )


def _directional_moves(rows: DataFrame) -> DataFrame:
    high, low, prev = F.col("high_price"), F.col("low_price"), F.col("_pclose")
    up, down = high - F.col("_phigh"), F.col("_plow") - low
    return rows.select(
        "*",
        F.greatest(high - low, F.abs(high - prev), F.abs(low - prev)).alias("_tr"),
        F.when((up > down) & (up > 0), up).otherwise(0.0).alias("_plus"),
        F.when((down > up) & (down > 0), down).otherwise(0.0).alias("_minus"),
    )


def adx(bars: DataFrame, periods: int = 14, layout: Layout = Layout()) -> DataFrame:
    """Average directional index after Wilder; null until both smoothings are filled."""
    alpha = 1 / periods
    pieces = cut_bars(
        bars,
        fitting(layout, [alpha]),
        lags={"_pclose": "close_price", "_phigh": "high_price", "_plow": "low_price"},
        derive=_directional_moves,
    )
    specs = [
        Ewm("_atr", "_tr", alpha, 1, periods),
        Ewm("_plus_s", "_plus", alpha, 1, periods),
        Ewm("_minus_s", "_minus", alpha, 1, periods),
    ]
    smooth = ewm_mean(pieces.rows, pieces, specs)
    plus, minus = F.col("_pdi"), F.col("_mdi")
    spread = ratio(F.abs(plus - minus), plus + minus, 100.0)
    directional = smooth.withColumns(
        {
            "_pdi": ratio(F.col("_plus_s"), F.col("_atr"), 100.0),
            "_mdi": ratio(F.col("_minus_s"), F.col("_atr"), 100.0),
        }
    ).withColumn("_dx", F.coalesce(spread, F.lit(0.0)))
    averaged = ewm_mean(
        directional, pieces, [Ewm("_adx", "_dx", alpha, periods, periods)], from_source=False
    )
    return _finish(
        averaged,
        bars,
        {
            "plus_di": round_even("_pdi", 4),
            "minus_di": round_even("_mdi", 4),
            "adx_14": round_even("_adx", 4),
        },
    )


def cci(bars: DataFrame, periods: int = 14, layout: Layout = Layout()) -> DataFrame:
    """Commodity channel index with Lambert's constant 0.015; null until the frame is full."""
    typical = (F.col("high_price") + F.col("low_price") + F.col("close_price")) / 3
    pieces = cut_bars(
        bars, layout, halo=periods - 1, derive=lambda rows: rows.withColumn("_tp", typical)
    )
    frame = block_window(KEYS, periods - 1)
    framed = pieces.rows.select(
        "*", F.avg("_tp").over(frame).alias("_sma"), F.collect_list("_tp").over(frame).alias("_frame")
    )
    deviation = (
        F.aggregate("_frame", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_sma"))) / periods
    )
    value = F.when(
        F.col(INDEX) >= periods - 1, ratio(F.col("_tp") - F.col("_sma"), F.lit(0.015) * deviation)
    )
    return _finish(framed, bars, {"cci_14": round_even(value, 4)})


def sharpe(
    bars: DataFrame, risk_free_pct: float = 4.5, sessions: int = 252, layout: Layout = Layout()
) -> DataFrame:
    """Yearly Sharpe ratio per ticker from daily percent returns."""
    daily = cut_bars(bars, layout, lags={"_prev": "close_price"}).source.select(
        "ticker",
        F.year("trading_date").cast("int").alias("year"),
        _percent_change().alias("_return"),
    )
    stats = daily.groupBy("ticker", "year").agg(
        F.avg("_return").alias("_mean"),
        F.stddev_samp("_return").alias("_std"),
        F.count("_return").alias("sessions"),
    )
    excess = F.col("_mean") * sessions - risk_free_pct
    spread = F.col("_std") * F.sqrt(F.lit(float(sessions)))
    return stats.select(
        "ticker", "year", "sessions", F.round(ratio(excess, spread), 4).alias("sharpe_ratio")
    )


MARKET_FEATURES = ["rsi_14", "macd", "macd_signal", "adx_14", "cci_14"]


def technicals(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """RSI, MACD with its signal, ADX and CCI of every bar from one cut of the series.

    The smoothed columns share a pass, and the two that smooth results share another.
    """
    wilder = 1 / 14
    fast, slow, signal = (2 / (n + 1) for n in (12, 26, 9))
    typical = (F.col("high_price") + F.col("low_price") + F.col("close_price")) / 3
    pieces = cut_bars(
        bars,
        fitting(layout, [wilder, fast, slow, signal]),
        halo=13,
        lags={
            "_prev": "close_price",
            "_pclose": "close_price",
            "_phigh": "high_price",
            "_plow": "low_price",
        },
        derive=lambda rows: _directional_moves(_with_moves(rows)).withColumn("_tp", typical),
    )
    frame = block_window(KEYS, 13)
    framed = pieces.rows.select(
        "*", F.avg("_tp").over(frame).alias("_sma"), F.collect_list("_tp").over(frame).alias("_frame")
    )
    specs = [
        Ewm("_avg_gain", "_gain", wilder, 1, 14),
        Ewm("_avg_loss", "_loss", wilder, 1, 14),
        Ewm("_atr", "_tr", wilder, 1, 14),
        Ewm("_plus_s", "_plus", wilder, 1, 14),
        Ewm("_minus_s", "_minus", wilder, 1, 14),
        Ewm("_fast", "close_price", fast),
        Ewm("_slow", "close_price", slow),
    ]
    first = ewm_mean(framed, pieces, specs)
    plus, minus, atr = F.col("_plus_s"), F.col("_minus_s"), F.col("_atr")
    pdi, mdi = ratio(plus, atr, 100.0), ratio(minus, atr, 100.0)
    second = ewm_mean(
        first.select(
            "*",
            (F.col("_fast") - F.col("_slow")).alias("_macd"),
            F.coalesce(ratio(F.abs(pdi - mdi), pdi + mdi, 100.0), F.lit(0.0)).alias("_dx"),
        ),
        pieces,
        [Ewm("_signal", "_macd", signal), Ewm("_adx", "_dx", wilder, 14, 14)],
        from_source=False,
    )
    gain, loss = F.col("_avg_gain"), F.col("_avg_loss")
    rsi = F.when(gain.isNotNull(), F.coalesce(_rsi(F.try_divide(gain, loss)), F.lit(100.0)))
    deviation = (
        F.aggregate("_frame", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_sma"))) / 14
    )
    cci_value = F.when(
        F.col(INDEX) >= 13, ratio(F.col("_tp") - F.col("_sma"), F.lit(0.015) * deviation)
    )
    return _finish(
        second,
        bars,
        {
            "rsi_14": round_even(rsi, 4),
            "macd": round_even("_macd", 4),
            "macd_signal": round_even("_signal", 4),
            "adx_14": round_even("_adx", 4),
            "cci_14": round_even(cci_value, 4),
        },
    )


def market_features(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """The market columns of a company-year: Sharpe ratio and year-end indicator values."""
    snapshot = year_end_snapshot(technicals(bars, layout), MARKET_FEATURES)
    yearly = sharpe(bars, layout=layout).drop("sessions")
    return yearly.join(snapshot, ["ticker", "year"])


def year_end_snapshot(bars_with_indicators: DataFrame, columns: list[str]) -> DataFrame:
    """Values of the last bar of each ticker-year."""
    last = F.max_by(F.struct(*columns), "trading_date").alias("_last")
    return (
        bars_with_indicators.groupBy("ticker", F.year("trading_date").cast("int").alias("year"))
        .agg(last)
        .select("ticker", "year", "_last.*")
    )


def candle_direction(bars: DataFrame) -> DataFrame:
    return bars.withColumn(
        "direction", F.when(F.col("close_price") >= F.col("open_price"), "up").otherwise("down")
    )


def latest_quote(curated: DataFrame) -> DataFrame:
    """Last bar per ticker with the change to the bar before it (0 for a single bar).

    The rank filter is applied on the map side first, so a ticker of any length sends
    at most two rows per task to the shuffle.
    """
    newest = Window.partitionBy("ticker").orderBy(F.col("trading_date").desc())
    two = curated.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= 2)
    kept = ["trading_date", "close_price", "volume", "ma20", "rsi_14"]
    pair = two.groupBy("ticker").agg(
        F.max_by(F.struct(*kept), "trading_date").alias("_last"),
        F.min_by("close_price", "trading_date").alias("previous_close"),
    )
    return pair.select(
        "ticker",
        "_last.*",
        "previous_close",
        F.round(F.col("_last.close_price") - F.col("previous_close"), 4).alias("delta"),
    )
