"""Company master data, reports and the attempt ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.text import FINANCIAL_WORDS, FINANCIAL_WORDS_EN
from ledgerline.operators import companies as ops
from ledgerline.operators import dedup, ledger
from ledgerline.operators.indicators import indicators_two_decimals
from ledgerline.plans.inputs import BARS_SQL, COMPANIES_SQL, companies, stored_bars, table
from ledgerline.plans.market import NUMBERED_SQL, WILDER_SQL
from ledgerline.plans.registry import Catalog, with_parts
from ledgerline.schemas import SOURCE_CSV
from ledgerline.session import configure, work_dir
from ledgerline.sinks.curated import write_curated
from ledgerline.sinks.reports import write_report
from ledgerline.sources.curated import read_curated
from ledgerline.sources.tables import first_tickers, in_file_order, read_bar_samples, read_universe

listed = Catalog()

_FINANCIAL = " OR ".join(
    f"contains(lower(industry), '{w}')" for w in FINANCIAL_WORDS + FINANCIAL_WORDS_EN
)
CLASSIFIED_SQL = f"""
classified AS (
  SELECT *, ({_FINANCIAL}) AS is_financial,
         CASE WHEN {_FINANCIAL} THEN 'Tài chính' ELSE 'Phi tài chính' END AS sector, 'LISTED' AS status
  FROM companies)
"""

MARKET_SPELLINGS = ["hsx", "HOSE", "Hnx", "UpcomIndex", "other"]
# Companies as an exchange would list them: market spelled in several ways.
MASTER_SQL = """
master AS (
  SELECT c_custkey AS ordinal, 'C' || c_custkey AS symbol, c_name AS organ_name,
         list_extract(['hsx', 'HOSE', 'Hnx', 'UpcomIndex', 'other'], CAST(c_nationkey % 5 + 1 AS INT)) AS exchange
  FROM customer),
markets AS (
  SELECT ordinal, symbol AS ticker, organ_name AS name,
         CASE upper(exchange) WHEN 'HSX' THEN 'HOSE' WHEN 'UPCOMINDEX' THEN 'UPCOM' ELSE upper(exchange) END AS market
  FROM master)
"""


def master(spark, sf_dir):
    spelled = F.element_at(
        F.array(*[F.lit(m) for m in MARKET_SPELLINGS]), (F.col("c_nationkey") % 5 + 1).cast("int")
    )
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ordinal"),
        F.concat(F.lit("C"), "c_custkey").alias("symbol"),
        F.col("c_name").alias("organ_name"),
        spelled.alias("exchange"),
    )


def markets(spark, sf_dir):
    return ops.normalize_market(ops.backfill_schema(master(spark, sf_dir)))


def _universe_files(spark, sf_dir) -> str:
    """The company list as CSV files, in list order."""
    path = work_dir(configure(spark), "universe")
    rows = (
        markets(spark, sf_dir)
        .orderBy("ordinal")
        .select(
            F.lower("ticker").alias("ticker"),
            "name",
            "market",
            F.lit("General").alias("sector"),
            F.lit("v1").alias("version"),
            F.lit("2026-07-19").alias("effective_date"),
        )
    )
    write_report(rows, path)
    return path


@listed.query(
    "universe_scan",
    with_parts(
        MASTER_SQL,
        body="""SELECT ticker, name, market, 'General' AS sector, 'v1' AS version, '2026-07-19' AS effective_date
                FROM markets""",
    ),
)
def universe_scan(spark, sf_dir):
    return read_universe(spark, _universe_files(spark, sf_dir))


@listed.query(
    "load_tickers", with_parts(MASTER_SQL, body="SELECT ticker FROM markets ORDER BY ordinal LIMIT 100")
)
def load_tickers(spark, sf_dir):
    universe = read_universe(spark, _universe_files(spark, sf_dir))
    return first_tickers(in_file_order(universe), 100)


@listed.query("ohlcv_csv_scan", with_parts(BARS_SQL, body="SELECT * FROM bars"))
def ohlcv_csv_scan(spark, sf_dir):
    path = work_dir(configure(spark), "samples")
    named = stored_bars(spark, sf_dir).select(
        "ticker",
        F.lit(1).alias("sample_row"),
        F.date_format("trading_date", "M/d/yyyy").alias("time"),
        *[F.col(f"{n}_price").alias(n) for n in ["open", "high", "low", "close"]],
        "volume",
    )
    write_report(named.select(*SOURCE_CSV.names), path)
    return read_bar_samples(spark, path)


@listed.query(
    "report_sink",
    """SELECT c_custkey, c_name, c_mktsegment FROM customer""",
)
def report_sink(spark, sf_dir):
    path = work_dir(configure(spark), "report")
    report = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    write_report(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


@listed.query(
    "curated_sink_legacy",
    with_parts(
        BARS_SQL,
        NUMBERED_SQL,
        WILDER_SQL,
        body="""
        SELECT n.ticker, n.trading_date, n.close_price, round_even(((n.close_price / n.prev_close - 1) * 100) * 1e2, 0) / 1e2 AS "return",
               round_even((CASE WHEN avg_loss = 0 AND avg_gain > 0 THEN 100
                          ELSE 100 - 100 / (1 + avg_gain / nullif(avg_loss, 0)) END) * 1e2, 0) / 1e2 AS rsi_14
        FROM numbered n LEFT JOIN wilder w ON w.ticker = n.ticker AND w.k = n.k""",
        recursive=True,
    ),
)
def curated_sink_legacy(spark, sf_dir):
    root = work_dir(configure(spark), "curated")
    curated = indicators_two_decimals(stored_bars(spark, sf_dir))
    write_curated(curated, root, replace_all=True)
    return read_curated(spark, root, curated.schema).select(
        "ticker", "trading_date", "close_price", "return", "rsi_14"
    )


@listed.query(
    "text_search",
    with_parts(
        COMPANIES_SQL,
        body="""SELECT ticker, name, exchange, industry FROM companies
                WHERE contains(lower(ticker), '42') OR contains(lower(name), '42')""",
    ),
)
def text_search(spark, sf_dir):
    found = ops.search(companies(spark, sf_dir), "42", ["ticker", "name"])
    return found.select("ticker", "name", "exchange", "industry")


@listed.query(
    "facet_filter",
    with_parts(
        COMPANIES_SQL,
        body="SELECT ticker, name, exchange, industry FROM companies WHERE exchange = 'ASIA' AND industry = 'Ngân hàng'",
    ),
)
def facet_filter(spark, sf_dir):
    chosen = ops.facets(companies(spark, sf_dir), exchange="ASIA", industry="Ngân hàng", name="ALL")
    return chosen.select("ticker", "name", "exchange", "industry")


@listed.query(
    "exclude_financial",
    with_parts(
        COMPANIES_SQL,
        CLASSIFIED_SQL,
        body="SELECT ticker, industry, is_financial, sector, status FROM classified WHERE NOT is_financial",
    ),
)
def exclude_financial(spark, sf_dir):
    kept = ops.exclude_financial(ops.classify(companies(spark, sf_dir)))
    return kept.select("ticker", "industry", "is_financial", "sector", "status")


@listed.query(
    "company_counts",
    with_parts(
        COMPANIES_SQL,
        CLASSIFIED_SQL,
        body="""SELECT count(*) AS total, count(*) FILTER (WHERE is_financial) AS financial,
                       count(*) FILTER (WHERE NOT is_financial AND exchange = 'EUROPE') AS filtered FROM classified""",
    ),
)
def company_counts(spark, sf_dir):
    classified = ops.classify(companies(spark, sf_dir))
    shown = ops.exclude_financial(ops.facets(classified, exchange="EUROPE"))
    return ops.company_counts(classified, shown)


@listed.query(
    "distinct_values",
    with_parts(COMPANIES_SQL, body="SELECT DISTINCT industry FROM companies ORDER BY industry"),
)
def distinct_industries(spark, sf_dir):
    return ops.distinct_values(companies(spark, sf_dir), "industry")


@listed.query(
    "market_normalize", with_parts(MASTER_SQL, body="SELECT ticker, market FROM markets")
)
def market_normalize(spark, sf_dir):
    return markets(spark, sf_dir).select("ticker", "market")


@listed.query(
    "schema_backfill",
    with_parts(
        MASTER_SQL,
        body="SELECT symbol AS ticker, organ_name AS name, exchange AS market, '' AS sector FROM master",
    ),
)
def schema_backfill(spark, sf_dir):
    return ops.backfill_schema(master(spark, sf_dir)).select(*ops.MASTER_COLUMNS)


@listed.query(
    "market_quota",
    with_parts(
        MASTER_SQL,
        body="""
        SELECT ticker, name, market, CAST(r AS INT) AS market_rank
        FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ordinal) AS r FROM markets) m
        WHERE r <= CASE market WHEN 'HOSE' THEN 70 WHEN 'HNX' THEN 20 WHEN 'UPCOM' THEN 10 ELSE 0 END""",
    ),
)
def market_quota(spark, sf_dir):
    picked = ops.market_quota(markets(spark, sf_dir), "ordinal")
    return picked.select("ticker", "name", "market", "market_rank")


@listed.query(
    "market_counts",
    with_parts(
        MASTER_SQL,
        body="""SELECT market, count(*) AS companies FROM markets GROUP BY market
                UNION ALL SELECT 'TOTAL', count(*) FROM markets""",
    ),
)
def market_counts(spark, sf_dir):
    return ops.market_counts(markets(spark, sf_dir))


@listed.query(
    "union_frames",
    """
    SELECT 'C' || c_custkey AS ticker, c_name AS name, c_mktsegment AS sector, NULL AS market FROM customer
    UNION ALL SELECT 'S' || s_suppkey, s_name, NULL, 'UPCOM' FROM supplier""",
)
def union_frames(spark, sf_dir):
    first = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("ticker"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("sector"),
    )
    second = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("ticker"),
        F.col("s_name").alias("name"),
        F.lit("UPCOM").alias("market"),
    )
    return first.unionByName(second, allowMissingColumns=True)


# An exchange list that repeats tickers, and symbols that lack some of them.
EXCHANGE_SQL = """
exchange_list AS (
  SELECT 'C' || o_custkey AS ticker, o_orderpriority AS exchange, o_orderkey AS listed_at FROM orders),
first_listing AS (
  SELECT ticker, min_by(exchange, listed_at) AS exchange FROM exchange_list GROUP BY ticker)
"""


def _exchange_list(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), "o_custkey").alias("ticker"),
        F.col("o_orderpriority").alias("exchange"),
        F.col("o_orderkey").alias("listed_at"),
    )


@listed.query(
    "dedup_first", with_parts(EXCHANGE_SQL, body="SELECT ticker, exchange FROM first_listing")
)
def dedup_first(spark, sf_dir):
    return dedup.keep_first(_exchange_list(spark, sf_dir), ["ticker"], "listed_at")


LISTING_SQL = """
listing AS (
  SELECT f.ticker, f.exchange, c_name AS name
  FROM first_listing f LEFT JOIN customer ON 'C' || c_custkey = f.ticker AND c_acctbal >= 0)
"""


def _listing(spark, sf_dir):
    symbols = (
        table(spark, sf_dir, "customer")
        .filter("c_acctbal >= 0")
        .select(
            F.concat(F.lit("C"), "c_custkey").alias("ticker"),
            F.col("c_name").alias("name"),
            F.col("c_custkey").alias("position"),
        )
    )
    return ops.listing(_exchange_list(spark, sf_dir), symbols, "listed_at")


@listed.query(
    "listing_join", with_parts(EXCHANGE_SQL, LISTING_SQL, body="SELECT * FROM listing")
)
def listing_join(spark, sf_dir):
    return _listing(spark, sf_dir)


@listed.query(
    "overview_enrich",
    with_parts(
        EXCHANGE_SQL,
        LISTING_SQL,
        body="""
        SELECT l.ticker, l.exchange,
               coalesce(CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 'Overview ' || c_name END, l.name) AS name,
               c_mktsegment AS sector,
               CASE c_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS listing,
               CASE WHEN c_nationkey % 2 = 0 THEN '2020-01-15' END AS listing_date,
               'Short ' || c_custkey AS short_name, c_name || ' of nation ' || c_nationkey AS company_profile,
               CASE WHEN c_acctbal < 0 THEN 'CT' WHEN c_acctbal >= 0 THEN 'NH' END AS com_type_code, 'G' || c_nationkey AS com_group_code,
               CASE WHEN c_custkey % 5 <> 0 THEN 'tag' || (c_custkey % 5) END AS tag,
               CAST(c_nationkey * 10 AS VARCHAR) AS icb_code_lv2, 'FEED' AS source, '2025-01-31' AS updated_at
        FROM listing l LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 7) c ON 'C' || c_custkey = l.ticker""",
    ),
)
def overview_enrich(spark, sf_dir):
    nation = F.col("c_nationkey")
    overview = (
        table(spark, sf_dir, "customer")
        .filter(nation != 7)
        .select(
            F.concat(F.lit("C"), "c_custkey").alias("ticker"),
            F.when(nation % 3 == 0, "").otherwise(F.concat(F.lit("Overview "), "c_name")).alias("name"),
            F.col("c_mktsegment").alias("sector"),
            F.when(nation % 4 == 0, "true").when(nation % 4 == 1, "false").when(nation % 4 == 2, "unknown").alias("listing"),
            F.when(nation % 2 == 0, "2020-01-15").otherwise("unknown").alias("listing_date"),
            F.concat(F.lit("Short "), "c_custkey").alias("short_name"),
            F.concat("c_name", F.lit(" of nation "), nation).alias("company_profile"),
            F.when(F.col("c_acctbal") < 0, "CT").otherwise("NH").alias("com_type_code"),
            F.concat(F.lit("G"), nation).alias("com_group_code"),
            F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("tag"), F.col("c_custkey") % 5)).alias("tag"),
            (nation * 10).alias("icb_code_lv2"),
        )
    )
    return ops.enrich(_listing(spark, sf_dir), overview, "FEED", "2025-01-31")


# Ledger: every event is an attempt of its user's ticker; "error" events failed.
LEDGER_SQL = """
attempts AS (
  SELECT 'U' || user_id AS ticker, CASE event_type WHEN 'error' THEN 'FAIL' ELSE 'PASS' END AS status,
         CASE event_type WHEN 'error' THEN 'code ' || value END AS error, ts AS event_at, event_id FROM events),
state AS (
  SELECT ticker, status, error, event_at FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_at DESC, event_id DESC) AS r FROM attempts) a WHERE r = 1)
"""


def _attempts(spark, sf_dir):
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), "user_id").alias("ticker"),
        F.when(failed, "FAIL").otherwise("PASS").alias("status"),
        F.when(failed, F.concat(F.lit("code "), F.col("value").cast("string"))).alias("error"),
        F.col("ts").alias("event_at"),
        "event_id",
    )


def _state(spark, sf_dir):
    return ledger.current_state(_attempts(spark, sf_dir))


@listed.query("ledger_update", with_parts(LEDGER_SQL, body="SELECT * FROM state"))
def ledger_update(spark, sf_dir):
    return _state(spark, sf_dir)


@listed.query(
    "checkpoint_stats",
    with_parts(
        LEDGER_SQL,
        body="""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed,
                       count(*) FILTER (WHERE status = 'FAIL') AS failed, max(event_at) AS completed_at FROM state""",
    ),
)
def checkpoint_stats(spark, sf_dir):
    return ledger.checkpoint_stats(_state(spark, sf_dir))


@listed.query(
    "failed_tickers",
    with_parts(LEDGER_SQL, body="SELECT ticker, error, event_at FROM state WHERE status = 'FAIL'"),
)
def failed_tickers(spark, sf_dir):
    return ledger.failed_tickers(_state(spark, sf_dir))


@listed.query(
    "resume_worklist",
    with_parts(
        LEDGER_SQL,
        body="""SELECT ticker, position FROM (SELECT 'U' || c_custkey AS ticker, c_custkey AS position FROM customer) q
                WHERE ticker NOT IN (SELECT ticker FROM state WHERE status = 'PASS')""",
    ),
)
def resume_worklist(spark, sf_dir):
    requested = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("U"), "c_custkey").alias("ticker"), F.col("c_custkey").alias("position")
    )
    return ledger.resume_worklist(requested, _state(spark, sf_dir))
