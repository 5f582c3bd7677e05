"""Queries that serve the curated layer."""

from __future__ import annotations

from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.indicators import candle_direction, numbered_bars
from ledgerline.operators.series import INDEX, running_sums

MAX_PRICE_PAGE = 1000
MAX_COMPANY_PAGE = 100


class Page(NamedTuple):
    rows: DataFrame
    total: DataFrame


def price_filter(
    curated: DataFrame, ticker: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """One ticker between optional inclusive dates.

    Bounds are midnights compared with the full timestamp, so an intraday bar on the end
    date lies outside. The ticker is a literal, never spliced into text: it prunes
    partitions and cannot inject.
    """
    if start and end and start > end:
        raise ValueError("start_date must not be after end_date")
    rows = curated.filter(F.col("ticker") == F.lit(ticker.strip().upper()))
    if start:
        rows = rows.filter(F.col("trading_date") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        rows = rows.filter(F.col("trading_date") <= F.lit(end).cast("timestamp_ntz"))
    return rows


def project(curated: DataFrame) -> DataFrame:
    """The served columns, with the timestamp cut to its date."""
    return curated.withColumn("trading_date", F.to_date("trading_date"))


def _check_page(page: int, limit: int, most: int) -> None:
    if page < 1 or not 1 <= limit <= most:
        raise ValueError(f"page starts at 1 and limit lies in 1..{most}")


def _price_page(rows: DataFrame, page: int, limit: int) -> DataFrame:
    """A page by date. An offset collects everything before the page on the driver, so rows
    are taken by their position instead, which is counted in parallel."""
    offset = (page - 1) * limit
    numbered = numbered_bars(rows)
    wanted = F.col(INDEX).between(offset, offset + limit - 1)
    return numbered.filter(wanted).drop(INDEX).orderBy("trading_date").limit(limit)


def _month_days(day: str) -> tuple[str, str]:
    """First days of the month of a date and of the one after it."""
    first = date.fromisoformat(day[:10]).replace(day=1)
    return first.isoformat(), (first + timedelta(days=32)).replace(day=1).isoformat()


def _between(rows: DataFrame, first: str | None, past: str | None) -> DataFrame:
    at = F.col("trading_date")
    rows = rows.filter(at >= F.lit(first).cast("timestamp_ntz")) if first else rows
    return rows.filter(at < F.lit(past).cast("timestamp_ntz")) if past else rows


def _page_by_month(
    curated: DataFrame, positions: DataFrame, ticker: str, start: str | None, end: str | None, page: int, limit: int
) -> Page:
    """A page that reads the months it lies in, and the month of the first bound.

    ``positions`` has a row per month of the ticker, a few hundred in all: they come to the
    driver. Inside a month rows are skipped by an offset, of one month's rows at most.
    """
    one = price_filter(curated, ticker)
    months = positions.filter(F.col("ticker") == F.lit(ticker.strip().upper()))
    counts = sorted((r["month"].isoformat(), r["rows"]) for r in months.collect())
    first = _month_days(start)[0] if start else None
    last = _month_days(end)[0] if end else None
    held = [(m, n) for m, n in counts if (not first or m >= first) and (not last or m <= last)]
    # Rows of the first month that lie before the bound are skipped with the pages before.
    ahead = 0
    if start and held and held[0][0] == first:
        ahead = _between(one, first, None).filter(F.col("trading_date") < F.lit(start).cast("timestamp_ntz")).count()
    skip, seen, wanted = ahead + (page - 1) * limit, 0, []
    for month, n in held:
        if seen + n > skip and seen < skip + limit:
            wanted.append((month, seen))
        seen += n
    if wanted:
        rows = _between(one, wanted[0][0], _month_days(wanted[-1][0])[1])
        rows = price_filter(rows, ticker, None, end)
        taken = rows.orderBy("trading_date").offset(skip - wanted[0][1]).limit(limit)
    else:
        taken = price_filter(one, ticker, start, end).filter(F.lit(False)).orderBy("trading_date").limit(limit)
    whole = sum(n for m, n in held if m != last)
    tail = price_filter(_between(one, last, None), ticker, None, end) if last else one.filter(F.lit(False))
    total = tail.agg((F.count("*") + F.lit(whole - ahead)).alias("total_records"))
    if first and first == last:
        total = price_filter(one, ticker, start, end).agg(F.count("*").alias("total_records"))
    return Page(project(taken), total)


def prices_page(
    curated: DataFrame,
    ticker: str,
    start: str | None = None,
    end: str | None = None,
    page: int = 1,
    limit: int = 100,
    positions: DataFrame | None = None,
) -> Page:
    """One page of prices by date, and the number of rows behind all pages.

    With ``positions``, which the curated sink keeps, both come from the months concerned;
    without, positions are counted over all rows of the ticker.
    """
    _check_page(page, limit, MAX_PRICE_PAGE)
    rows = price_filter(curated, ticker, start, end)
    if positions is not None:
        return _page_by_month(curated, positions, ticker, start, end, page, limit)
    total = rows.agg(F.count("*").alias("total_records"))
    return Page(project(_price_page(rows, page, limit)), total)


def prices_after(
    curated: DataFrame, ticker: str, after: str | None = None, limit: int = 100
) -> DataFrame:
    """The page that follows a date already seen.

    The date predicate reaches the scan, so a late page costs as much as the first one;
    an offset reads everything before it.
    """
    rows = price_filter(curated, ticker)
    if after:
        rows = rows.filter(F.col("trading_date") > F.lit(after).cast("timestamp_ntz"))
    return project(rows.orderBy("trading_date").limit(limit))


def recent(curated: DataFrame, ticker: str, sessions: int = 30) -> DataFrame:
    """The last sessions, newest first."""
    return price_filter(curated, ticker).orderBy(F.col("trading_date").desc()).limit(sessions)


def preview(curated: DataFrame, ticker: str, rows: int = 15) -> DataFrame:
    return price_filter(curated, ticker).orderBy("trading_date").limit(rows)


def candles(curated: DataFrame, ticker: str) -> DataFrame:
    """Chart series of one ticker by date."""
    shown = ["trading_date", "open_price", "high_price", "low_price", "close_price", "ma20", "volume"]
    return (
        candle_direction(price_filter(curated, ticker))
        .select("ticker", *shown, "direction")
        .orderBy("trading_date")
    )


def available_tickers(curated: DataFrame) -> DataFrame:
    return curated.select("ticker").distinct()


def companies(curated: DataFrame, universe: DataFrame) -> DataFrame:
    """Tickers with data, described by the universe where it knows them."""
    described = universe.select("ticker", "name", "market", "sector")
    return available_tickers(curated).join(described, "ticker", "left")


def known_companies(curated: DataFrame, universe: DataFrame) -> DataFrame:
    """Universe rows that have data."""
    return universe.join(available_tickers(curated), "ticker", "left_semi")


def unknown_tickers(curated: DataFrame, universe: DataFrame) -> DataFrame:
    """Tickers with data that the universe does not know."""
    return available_tickers(curated).join(universe, "ticker", "left_anti")


def companies_page(listed: DataFrame, page: int = 1, limit: int = 50) -> Page:
    """One page of companies by ticker, and their number."""
    _check_page(page, limit, MAX_COMPANY_PAGE)
    total = listed.agg(F.count("*").alias("total_records"))
    # Tickers are counted per beginning, so no task and no driver orders all of them.
    placed = running_sums(
        listed.withColumn("_bin", F.substring("ticker", 1, 4)), [], [F.col("ticker")], "_bin", {"_at": F.lit(1)}
    )
    wanted = F.col("_at").between((page - 1) * limit + 1, page * limit)
    return Page(placed.filter(wanted).orderBy("ticker").limit(limit).select(*listed.columns), total)


def companies_after(listed: DataFrame, after: str | None = None, limit: int = 50) -> DataFrame:
    """The companies that follow a ticker already seen; late pages cost what early ones do."""
    rows = listed.filter(F.col("ticker") > F.lit(after)) if after else listed
    return rows.orderBy("ticker").limit(limit)
