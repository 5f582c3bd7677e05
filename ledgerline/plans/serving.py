"""Queries over the stored curated layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import dedup, serving
from ledgerline.operators.indicators import numbered_bars
from ledgerline.operators.series import INDEX, running_sums
from ledgerline.plans.inputs import BRAND_UNIVERSE_SQL, brand_universe, stored_bars
from ledgerline.plans.market import curated as compute_curated
from ledgerline.plans.market import curated_oracle
from ledgerline.plans.registry import Catalog
from ledgerline.schemas import CURATED, CURATED_COLUMNS, RECORD_COLUMNS
from ledgerline.session import configure, source_version, work_dir
from ledgerline.sinks.curated import read_positions, write_curated
from ledgerline.sinks.reports import price_export, write_export
from ledgerline.sources.curated import inventory_by_ticker, read_curated, stored_files

served = Catalog()
TICKER = "BRAND.7"
START, END = "1996-03-01", "1999-06-30"

_ROOTS: dict = {}


def curated_root(spark, sf_dir) -> str:
    """The curated layer, written once per application and input folder."""
    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir, source_version(spark, sf_dir))
    if key not in _ROOTS:
        root = work_dir(spark, "curated")
        computed = compute_curated(spark, sf_dir).select(*CURATED_COLUMNS)
        write_curated(computed, root, dates=stored_bars(spark, sf_dir))
        _ROOTS[key] = root
    return _ROOTS[key]


def curated(spark, sf_dir):
    return read_curated(spark, curated_root(spark, sf_dir))


_DATED = """ticker, CAST(trading_date AS DATE) AS trading_date, open_price, high_price, low_price, close_price,
       volume, return_pct, ma20, rsi_14"""
_RANGE = f"ticker = '{TICKER}' AND trading_date >= DATE '{START}' AND trading_date <= DATE '{END}'"


@served.query("curated_scan", curated_oracle("SELECT * FROM curated"))
def curated_scan(spark, sf_dir):
    return curated(spark, sf_dir)


@served.query(
    "curated_schema_union",
    curated_oracle(
        """SELECT ticker, trading_date, close_price, CASE WHEN year(trading_date) >= 1998 THEN rsi_14 END AS rsi_14
           FROM curated"""
    ),
)
def curated_schema_union(spark, sf_dir):
    """Older files without indicator columns next to newer ones with them."""
    rows = curated(spark, sf_dir)
    root = work_dir(spark, "mixed")
    older, newer = rows.filter(F.year("trading_date") < 1998), rows.filter(F.year("trading_date") >= 1998)
    older.select(*RECORD_COLUMNS).write.partitionBy("ticker").parquet(root)
    newer.write.mode("append").partitionBy("ticker").parquet(root)
    return read_curated(spark, root).select("ticker", "trading_date", "close_price", "rsi_14")


@served.query(
    "curated_inventory",
    curated_oracle("SELECT ticker, count(DISTINCT year(trading_date)) AS curated_files, true AS data_ready FROM curated GROUP BY ticker"),
)
def curated_inventory(spark, sf_dir):
    """Of a layer that is written year by year: a file per ticker and year."""
    root = work_dir(configure(spark), "inventory")
    rows = curated(spark, sf_dir).withColumn("year", F.year("trading_date"))
    rows.repartition("ticker", "year").write.partitionBy("ticker", "year").parquet(root)
    return inventory_by_ticker(stored_files(spark, root))


@served.query("curated_project", curated_oracle(f"SELECT {_DATED} FROM curated"))
def curated_project(spark, sf_dir):
    return serving.project(curated(spark, sf_dir))


@served.query("ticker_filter", curated_oracle(f"SELECT * FROM curated WHERE ticker = '{TICKER}'"))
def ticker_filter(spark, sf_dir):
    return serving.price_filter(curated(spark, sf_dir), f" {TICKER.lower()} ")


@served.query("date_filter", curated_oracle(f"SELECT * FROM curated WHERE {_RANGE}"))
def date_filter(spark, sf_dir):
    return serving.price_filter(curated(spark, sf_dir), TICKER, START, END)


@served.query(
    "prices_page",
    curated_oracle(
        f"SELECT {_DATED} FROM curated WHERE {_RANGE} ORDER BY curated.trading_date LIMIT 100 OFFSET 100"
    ),
)
def prices_page(spark, sf_dir):
    return _page(spark, sf_dir, 2).rows


def _page(spark, sf_dir, page):
    rows, positions = curated(spark, sf_dir), read_positions(spark, curated_root(spark, sf_dir))
    return serving.prices_page(rows, TICKER, START, END, page=page, positions=positions)


@served.query(
    "prices_deep_page",
    curated_oracle(
        """SELECT ticker, CAST(trading_date AS DATE) AS trading_date, close_price FROM (
             SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trading_date) AS r FROM curated) d
           WHERE r > 40 AND r <= 60"""
    ),
)
def prices_deep_page(spark, sf_dir):
    """The third page of twenty of every ticker, taken by position."""
    numbered = numbered_bars(curated(spark, sf_dir))
    page = numbered.filter(F.col(INDEX).between(40, 59))
    return serving.project(page).select("ticker", "trading_date", "close_price")


@served.query(
    "count_filtered",
    curated_oracle(f"SELECT count(*) AS total_records FROM curated WHERE {_RANGE}"),
)
def count_filtered(spark, sf_dir):
    return _page(spark, sf_dir, 1).total


@served.query(
    "prices_after",
    curated_oracle(
        f"""SELECT {_DATED} FROM curated WHERE ticker = '{TICKER}' AND curated.trading_date > TIMESTAMP '{START}'
            ORDER BY curated.trading_date LIMIT 100"""
    ),
)
def prices_after(spark, sf_dir):
    return serving.prices_after(curated(spark, sf_dir), TICKER, START)


@served.query(
    "export_order",
    curated_oracle(f"SELECT * FROM curated WHERE ticker = '{TICKER}' ORDER BY trading_date"),
)
def export_order(spark, sf_dir):
    return price_export(curated(spark, sf_dir), TICKER).rows


@served.query(
    "price_export",
    curated_oracle(
        f"""SELECT 'csv' AS format, ticker, count(*) AS row_count,
                   array_to_string(['{"', '".join(CURATED_COLUMNS)}'], ',') AS columns, '1.0' AS schema_version,
                   (SELECT count(*) FROM curated WHERE ticker = '{TICKER}') AS rows_written
            FROM curated WHERE ticker = '{TICKER}' GROUP BY ticker"""
    ),
)
def export_files(spark, sf_dir):
    """Write the export, then describe what the files hold."""
    path = work_dir(configure(spark), "export")
    write_export(price_export(curated(spark, sf_dir), TICKER), path)
    manifest = spark.read.schema(
        "source string, ticker string, export_time string, format string, row_count bigint,"
        " columns array<string>, schema_version string"
    ).json(f"{path}/manifest")
    rows = spark.read.schema(CURATED).option("header", True).csv(f"{path}/data")
    written = rows.groupBy("ticker").agg(F.count("*").alias("rows_written"))
    return manifest.join(written, "ticker").select(
        "format",
        "ticker",
        "row_count",
        F.array_join("columns", ",").alias("columns"),
        "schema_version",
        "rows_written",
    )


@served.query(
    "recent_desc",
    curated_oracle(
        f"SELECT * FROM curated WHERE ticker = '{TICKER}' ORDER BY trading_date DESC LIMIT 30"
    ),
)
def recent_desc(spark, sf_dir):
    return serving.recent(curated(spark, sf_dir), TICKER)


@served.query(
    "preview_head",
    curated_oracle(f"SELECT * FROM curated WHERE ticker = '{TICKER}' ORDER BY trading_date LIMIT 15"),
)
def preview_head(spark, sf_dir):
    return serving.preview(curated(spark, sf_dir), TICKER)


@served.query(
    "candles",
    curated_oracle(
        f"""SELECT ticker, trading_date, open_price, high_price, low_price, close_price, ma20, volume,
                   CASE WHEN close_price >= open_price THEN 'up' ELSE 'down' END AS direction
            FROM curated WHERE ticker = '{TICKER}'"""
    ),
)
def candles(spark, sf_dir):
    return serving.candles(curated(spark, sf_dir), TICKER)


@served.query(
    "sort_curated",
    curated_oracle(
        """SELECT ticker, trading_date, CAST(k AS BIGINT) AS position
           FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trading_date) AS k FROM curated) s"""
    ),
)
def sort_curated(spark, sf_dir):
    """Stored order: rows of a ticker lie by date inside and across its files."""
    rows = spark.read.schema(CURATED).option("basePath", curated_root(spark, sf_dir)).parquet(curated_root(spark, sf_dir))
    placed = rows.select("ticker", "trading_date", "_metadata.file_path", "_metadata.row_index")
    # Ranked inside a file, behind the rows of the ticker's files before it.
    numbered = running_sums(placed, ["ticker"], [F.col("row_index")], "file_path", {"position": F.lit(1)})
    return numbered.select("ticker", "trading_date", F.col("position").cast("bigint").alias("position"))


@served.query(
    "sample_rows",
    curated_oracle(
        """SELECT ticker, CAST(r AS INT) AS sample_row, trading_date, close_price FROM (
             SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trading_date) AS r FROM curated) s WHERE r <= 263"""
    ),
)
def sample_rows(spark, sf_dir):
    bars = stored_bars(spark, sf_dir)
    first = dedup.first_rows(bars, ["ticker"], F.col("trading_date"), 263, "sample_row")
    return first.select("ticker", "sample_row", "trading_date", "close_price")


_COMPANIES = """
  (SELECT a.ticker, u.name, u.market, u.sector FROM (SELECT DISTINCT ticker FROM curated) a
   LEFT JOIN universe u ON u.ticker = a.ticker)"""


@served.query("companies", curated_oracle(f"SELECT * FROM {_COMPANIES} c", BRAND_UNIVERSE_SQL))
def companies(spark, sf_dir):
    return serving.companies(curated(spark, sf_dir), brand_universe(spark, sf_dir))


@served.query(
    "companies_page",
    curated_oracle(
        f"SELECT * FROM {_COMPANIES} c ORDER BY ticker LIMIT 10 OFFSET 10", BRAND_UNIVERSE_SQL
    ),
)
def companies_page(spark, sf_dir):
    listed = serving.companies(curated(spark, sf_dir), brand_universe(spark, sf_dir))
    return serving.companies_page(listed, page=2, limit=10).rows


@served.query(
    "companies_after",
    curated_oracle(
        f"SELECT * FROM {_COMPANIES} c WHERE ticker > '{TICKER}' ORDER BY ticker LIMIT 10",
        BRAND_UNIVERSE_SQL,
    ),
)
def companies_after(spark, sf_dir):
    listed = serving.companies(curated(spark, sf_dir), brand_universe(spark, sf_dir))
    return serving.companies_after(listed, TICKER, 10)


@served.query(
    "companies_semi",
    curated_oracle(
        "SELECT * FROM universe WHERE ticker IN (SELECT ticker FROM curated)", BRAND_UNIVERSE_SQL
    ),
)
def companies_semi(spark, sf_dir):
    return serving.known_companies(curated(spark, sf_dir), brand_universe(spark, sf_dir))


_UNKNOWN = "SELECT DISTINCT ticker FROM curated WHERE ticker NOT IN (SELECT ticker FROM universe)"


@served.query("companies_anti", curated_oracle(_UNKNOWN, BRAND_UNIVERSE_SQL))
def companies_anti(spark, sf_dir):
    return serving.unknown_tickers(curated(spark, sf_dir), brand_universe(spark, sf_dir))


@served.query(
    "set_difference",
    curated_oracle(
        "SELECT DISTINCT ticker FROM curated EXCEPT SELECT ticker FROM universe", BRAND_UNIVERSE_SQL
    ),
)
def set_difference(spark, sf_dir):
    available = serving.available_tickers(curated(spark, sf_dir))
    return available.subtract(brand_universe(spark, sf_dir).select("ticker"))


@served.query(
    "distinct_tickers", curated_oracle("SELECT DISTINCT ticker FROM curated ORDER BY ticker")
)
def distinct_tickers(spark, sf_dir):
    return serving.available_tickers(curated(spark, sf_dir)).orderBy("ticker")
