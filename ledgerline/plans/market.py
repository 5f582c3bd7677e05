"""Price-series queries: indicators and yearly snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import indicators as ind
from ledgerline.plans.inputs import BARS_SQL, stored_bars
from ledgerline.plans.registry import Catalog, with_parts

market = Catalog()

# Numbered bars, the common ground of every oracle below.
NUMBERED_SQL = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trading_date) - 1 AS k,
         lag(close_price) OVER (PARTITION BY ticker ORDER BY trading_date) AS prev_close,
         lag(high_price) OVER (PARTITION BY ticker ORDER BY trading_date) AS prev_high,
         lag(low_price) OVER (PARTITION BY ticker ORDER BY trading_date) AS prev_low
  FROM bars)
"""

# Wilder averages bar by bar.
WILDER_SQL = """
moves AS (
  SELECT *, greatest(close_price - prev_close, 0) AS gain,
         greatest(prev_close - close_price, 0) AS loss FROM numbered),
wilder AS (
  SELECT ticker, k, gain AS avg_gain, loss AS avg_loss FROM moves WHERE k = 1
  UNION ALL
  SELECT m.ticker, m.k, w.avg_gain * 13.0e0 / 14.0e0 + m.gain / 14.0e0,
         w.avg_loss * 13.0e0 / 14.0e0 + m.loss / 14.0e0
  FROM wilder w JOIN moves m ON m.ticker = w.ticker AND m.k = w.k + 1)
"""

CURATED_SQL = (
    WILDER_SQL.strip()
    + """,
curated AS (
  SELECT n.ticker, n.trading_date, n.open_price, n.high_price, n.low_price, n.close_price, n.volume,
         round_even(((n.close_price / n.prev_close - 1) * 100) * 1e4, 0) / 1e4 AS return_pct,
         round_even((avg(n.close_price) OVER (PARTITION BY n.ticker ORDER BY n.trading_date
               ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) * 1e4, 0) / 1e4 AS ma20,
         CASE WHEN n.k >= 14 THEN round_even((coalesce(100 - 100 / (1 + avg_gain / nullif(avg_loss, 0)), 100)) * 1e4, 0) / 1e4 END AS rsi_14
  FROM numbered n LEFT JOIN wilder w ON w.ticker = n.ticker AND w.k = n.k)
"""
)


def curated_oracle(body: str, *more: str) -> str:
    return with_parts(BARS_SQL, NUMBERED_SQL, CURATED_SQL, *more, body=body, recursive=True)


def curated(spark, sf_dir):
    """Bars with return, MA20 and RSI14: the curated table without its storage."""
    return ind.indicators(stored_bars(spark, sf_dir))


@market.query(
    "latest_quote",
    curated_oracle(
        """
        SELECT ticker, trading_date, close_price, volume, ma20, rsi_14, previous_close,
               round(close_price - previous_close, 4) AS delta
        FROM (SELECT *, coalesce(lag(close_price) OVER w, close_price) AS previous_close,
                     row_number() OVER (PARTITION BY ticker ORDER BY trading_date DESC) AS r
              FROM curated WINDOW w AS (PARTITION BY ticker ORDER BY trading_date)) q
        WHERE r = 1"""
    ),
)
def latest_quote(spark, sf_dir):
    return ind.latest_quote(curated(spark, sf_dir))


@market.query("indicators", curated_oracle("SELECT * FROM curated"))
def all_indicators(spark, sf_dir):
    return curated(spark, sf_dir)


@market.query(
    "return_pct",
    with_parts(
        BARS_SQL,
        NUMBERED_SQL,
        body="""SELECT ticker, trading_date, round_even(((close_price / prev_close - 1) * 100) * 1e4, 0) / 1e4 AS return_pct
                FROM numbered""",
    ),
)
def return_pct(spark, sf_dir):
    return ind.returns(stored_bars(spark, sf_dir)).select("ticker", "trading_date", "return_pct")


def _ma_sql(periods: int) -> str:
    return with_parts(
        BARS_SQL,
        body=f"""SELECT ticker, trading_date, round_even((avg(close_price) OVER (PARTITION BY ticker
                 ORDER BY trading_date ROWS BETWEEN {periods - 1} PRECEDING AND CURRENT ROW)) * 1e4, 0) / 1e4 AS ma{periods}
                 FROM bars""",
    )


@market.query("ma20", _ma_sql(20))
def ma20(spark, sf_dir):
    return ind.moving_average(stored_bars(spark, sf_dir), 20).select("ticker", "trading_date", "ma20")


@market.query("ma50", _ma_sql(50))
def ma50(spark, sf_dir):
    return ind.moving_average(stored_bars(spark, sf_dir), 50).select("ticker", "trading_date", "ma50")


@market.query("rsi_14", curated_oracle("SELECT ticker, trading_date, rsi_14 FROM curated"))
def rsi_14(spark, sf_dir):
    return curated(spark, sf_dir).select("ticker", "trading_date", "rsi_14")


def _ema_recursion(name: str, value: str, source: str, q: str) -> str:
    """Recursive CTE ``name(ticker, k, y)`` over ``source(ticker, k, value)``."""
    return f"""
{name} AS (
  SELECT ticker, k, {value} AS y FROM {source} WHERE k = 0
  UNION ALL
  SELECT s.ticker, s.k, e.y * {q} + s.{value} * (1 - {q})
  FROM {name} e JOIN {source} s ON s.ticker = e.ticker AND s.k = e.k + 1)
"""


@market.query(
    "ewm_mean",
    with_parts(
        BARS_SQL,
        NUMBERED_SQL,
        _ema_recursion("ewm", "close_price", "numbered", "(13.0e0 / 14.0e0)"),
        body="""SELECT n.ticker, n.trading_date, round_even((y) * 1e4, 0) / 1e4 AS ewm_close
                FROM ewm JOIN numbered n ON n.ticker = ewm.ticker AND n.k = ewm.k""",
        recursive=True,
    ),
)
def ewm_close(spark, sf_dir):
    return ind.close_ewm(stored_bars(spark, sf_dir), alpha=1 / 14).select(
        "ticker", "trading_date", "ewm_close"
    )


@market.query(
    "indicators_legacy",
    with_parts(
        BARS_SQL,
        NUMBERED_SQL,
        WILDER_SQL,
        body="""
        SELECT n.ticker, n.trading_date, round_even(((n.close_price / n.prev_close - 1) * 100) * 1e2, 0) / 1e2 AS "return",
               round_even((avg(n.close_price) OVER (PARTITION BY n.ticker ORDER BY n.trading_date
                     ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) * 1e2, 0) / 1e2 AS ma20,
               round_even((CASE WHEN avg_loss = 0 AND avg_gain > 0 THEN 100
                          ELSE 100 - 100 / (1 + avg_gain / nullif(avg_loss, 0)) END) * 1e2, 0) / 1e2 AS rsi_14
        FROM numbered n LEFT JOIN wilder w ON w.ticker = n.ticker AND w.k = n.k""",
        recursive=True,
    ),
)
def indicators_legacy(spark, sf_dir):
    return ind.indicators_two_decimals(stored_bars(spark, sf_dir)).select(
        "ticker", "trading_date", "return", "ma20", "rsi_14"
    )


MACD_SQL = ",\n".join(
    part.strip()
    for part in [
        _ema_recursion("fast", "close_price", "numbered", "(11.0e0 / 13.0e0)"),
        _ema_recursion("slow", "close_price", "numbered", "(25.0e0 / 27.0e0)"),
        """macd_line AS (SELECT n.ticker, n.trading_date, n.k, f.y - s.y AS macd
             FROM numbered n JOIN fast f ON f.ticker = n.ticker AND f.k = n.k
                  JOIN slow s ON s.ticker = n.ticker AND s.k = n.k)""",
        _ema_recursion("signal", "macd", "macd_line", "0.8e0"),
    ]
)


@market.query(
    "macd",
    with_parts(
        BARS_SQL,
        NUMBERED_SQL,
        MACD_SQL,
        body="""SELECT l.ticker, l.trading_date, round_even((l.macd) * 1e4, 0) / 1e4 AS macd, round_even((g.y) * 1e4, 0) / 1e4 AS macd_signal
                FROM macd_line l JOIN signal g ON g.ticker = l.ticker AND g.k = l.k""",
        recursive=True,
    ),
)
def macd(spark, sf_dir):
    return ind.macd(stored_bars(spark, sf_dir)).select("ticker", "trading_date", "macd", "macd_signal")


ADX_SQL = """
dm AS (
  SELECT ticker, trading_date, k,
    greatest(high_price - low_price, abs(high_price - prev_close), abs(low_price - prev_close)) AS tr,
    CASE WHEN high_price - prev_high > prev_low - low_price AND high_price - prev_high > 0 THEN high_price - prev_high ELSE 0 END AS pdm,
    CASE WHEN prev_low - low_price > high_price - prev_high AND prev_low - low_price > 0 THEN prev_low - low_price ELSE 0 END AS mdm
  FROM numbered WHERE k >= 1),
smooth AS (
  SELECT ticker, k, tr AS atr, CAST(pdm AS DOUBLE) AS p, CAST(mdm AS DOUBLE) AS m FROM dm WHERE k = 1
  UNION ALL
  SELECT d.ticker, d.k, s.atr * 13.0e0 / 14.0e0 + d.tr / 14.0e0, s.p * 13.0e0 / 14.0e0 + d.pdm / 14.0e0,
         s.m * 13.0e0 / 14.0e0 + d.mdm / 14.0e0
  FROM smooth s JOIN dm d ON d.ticker = s.ticker AND d.k = s.k + 1),
di AS (
  SELECT ticker, k, p / nullif(atr, 0) * 100 AS pdi, m / nullif(atr, 0) * 100 AS mdi FROM smooth WHERE k >= 14),
dx AS (SELECT *, coalesce(abs(pdi - mdi) / nullif(pdi + mdi, 0) * 100, 0) AS dx FROM di),
adx AS (
  SELECT ticker, k, dx AS y FROM dx WHERE k = 14
  UNION ALL
  SELECT d.ticker, d.k, a.y * 13.0e0 / 14.0e0 + d.dx / 14.0e0
  FROM adx a JOIN dx d ON d.ticker = a.ticker AND d.k = a.k + 1)
"""


@market.query(
    "adx_14",
    with_parts(
        BARS_SQL,
        NUMBERED_SQL,
        ADX_SQL,
        body="""
        SELECT n.ticker, n.trading_date, round_even((pdi) * 1e4, 0) / 1e4 AS plus_di, round_even((mdi) * 1e4, 0) / 1e4 AS minus_di,
               CASE WHEN n.k >= 27 THEN round_even((a.y) * 1e4, 0) / 1e4 END AS adx_14
        FROM numbered n LEFT JOIN dx d ON d.ticker = n.ticker AND d.k = n.k
             LEFT JOIN adx a ON a.ticker = n.ticker AND a.k = n.k""",
        recursive=True,
    ),
)
def adx_14(spark, sf_dir):
    return ind.adx(stored_bars(spark, sf_dir)).select(
        "ticker", "trading_date", "plus_di", "minus_di", "adx_14"
    )


CCI_SQL = """
typical AS (SELECT ticker, trading_date, k, (high_price + low_price + close_price) / 3 AS tp FROM numbered),
framed AS (
  SELECT ticker, trading_date, k, tp, avg(tp) OVER w AS sma, list(tp) OVER w AS frame FROM typical
  WINDOW w AS (PARTITION BY ticker ORDER BY trading_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
"""


@market.query(
    "cci_14",
    with_parts(
        BARS_SQL,
        NUMBERED_SQL,
        CCI_SQL,
        body="""
        SELECT ticker, trading_date,
          CASE WHEN k >= 13 THEN round_even(((tp - sma) / nullif(0.015e0 *
            (list_sum(list_transform(frame, lambda x: abs(x - sma))) / 14), 0)) * 1e4, 0) / 1e4 END AS cci_14
        FROM framed""",
    ),
)
def cci_14(spark, sf_dir):
    return ind.cci(stored_bars(spark, sf_dir)).select("ticker", "trading_date", "cci_14")


@market.query(
    "sharpe",
    with_parts(
        BARS_SQL,
        NUMBERED_SQL,
        body="""
        SELECT ticker, CAST(year(trading_date) AS INT) AS year, count(r) AS sessions,
               round((avg(r) * 252 - 4.5) / nullif(stddev_samp(r) * sqrt(252.0), 0), 4) AS sharpe_ratio
        FROM (SELECT ticker, trading_date, (close_price / prev_close - 1) * 100 AS r FROM numbered) x
        GROUP BY ticker, year(trading_date)""",
    ),
)
def sharpe(spark, sf_dir):
    return ind.sharpe(stored_bars(spark, sf_dir))


_FEATURE_PARTS = [BARS_SQL, NUMBERED_SQL, WILDER_SQL, MACD_SQL, ADX_SQL, CCI_SQL]
_LAST_SQL = "last_bars AS (SELECT ticker, max(k) AS k FROM numbered GROUP BY ticker, year(trading_date))"


FEATURE_PARTS = [
    *_FEATURE_PARTS,
    _LAST_SQL,
    "yearly AS (SELECT ticker, year(trading_date) AS year, avg(r) AS m, stddev_samp(r) AS s FROM (SELECT ticker, trading_date, (close_price / prev_close - 1) * 100 AS r FROM numbered) x GROUP BY 1, 2)",
]
FEATURES_SQL = """
        SELECT n.ticker, CAST(y.year AS INT) AS year, round((y.m * 252 - 4.5) / nullif(y.s * sqrt(252.0), 0), 4) AS sharpe_ratio,
          CASE WHEN n.k >= 14 THEN round_even(coalesce(100 - 100 / (1 + w.avg_gain / nullif(w.avg_loss, 0)), 100) * 1e4, 0) / 1e4 END AS rsi_14,
          round_even(l.macd * 1e4, 0) / 1e4 AS macd, round_even(g.y * 1e4, 0) / 1e4 AS macd_signal,
          CASE WHEN n.k >= 27 THEN round_even(a.y * 1e4, 0) / 1e4 END AS adx_14,
          CASE WHEN n.k >= 13 THEN round_even((f.tp - f.sma) / nullif(0.015e0 *
            (list_sum(list_transform(f.frame, lambda x: abs(x - f.sma))) / 14), 0) * 1e4, 0) / 1e4 END AS cci_14
        FROM numbered n JOIN last_bars b ON b.ticker = n.ticker AND b.k = n.k
          JOIN yearly y ON y.ticker = n.ticker AND y.year = year(n.trading_date)
          JOIN macd_line l ON l.ticker = n.ticker AND l.k = n.k JOIN signal g ON g.ticker = n.ticker AND g.k = n.k
          JOIN framed f ON f.ticker = n.ticker AND f.k = n.k LEFT JOIN wilder w ON w.ticker = n.ticker AND w.k = n.k
          LEFT JOIN adx a ON a.ticker = n.ticker AND a.k = n.k"""


@market.query("market_features", with_parts(*FEATURE_PARTS, body=FEATURES_SQL, recursive=True))
def market_features(spark, sf_dir):
    return ind.market_features(stored_bars(spark, sf_dir))


@market.query(
    "technical_snapshot",
    curated_oracle(
        """
        SELECT ticker, CAST(year(trading_date) AS INT) AS year, max_by(close_price, trading_date) AS close_price,
               max_by(rsi_14, trading_date) AS rsi_14, max_by(ma20, trading_date) AS ma20
        FROM (SELECT *, max(trading_date) OVER (PARTITION BY ticker, year(trading_date)) AS last FROM curated) z
        WHERE trading_date = last
        GROUP BY ticker, year(trading_date)"""
    ),
)
def technical_snapshot(spark, sf_dir):
    return ind.year_end_snapshot(curated(spark, sf_dir), ["close_price", "rsi_14", "ma20"])


@market.query(
    "candle_direction",
    with_parts(
        BARS_SQL,
        body="""SELECT ticker, trading_date, open_price, close_price,
                       CASE WHEN close_price >= open_price THEN 'up' ELSE 'down' END AS direction FROM bars""",
    ),
)
def candle_direction(spark, sf_dir):
    return ind.candle_direction(stored_bars(spark, sf_dir)).select(
        "ticker", "trading_date", "open_price", "close_price", "direction"
    )
