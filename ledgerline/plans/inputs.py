"""Business inputs derived from the star-schema tables.

Bars come from line items (one series per brand), companies from customers, yearly
and quarterly statements from orders, ticks from events. Sums of money are rounded to
the digits their terms have, so results do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.schemas import RECORD_COLUMNS
from ledgerline.session import configure, source_version, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per brand; the first and last trade of a day set open and close.

    Only partial aggregates per (brand, day) cross the second shuffle; a hot part in
    the join is split by the adaptive skew join.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.upper(F.replace("p_brand", F.lit("#"), F.lit("."))).alias("ticker")
    )
    price = F.col("l_extendedprice") / F.col("l_quantity")
    trade = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("ticker", F.col("l_shipdate").alias("trading_date"), "l_quantity", price.alias("price"), trade.alias("trade"))
        .groupBy("ticker", "trading_date")
        .agg(
            F.min_by("price", "trade").alias("open_price"),
            F.max("price").alias("high_price"),
            F.min("price").alias("low_price"),
            F.max_by("price", "trade").alias("close_price"),
            F.sum("l_quantity").cast("bigint").alias("volume"),
        )
        .select(*RECORD_COLUMNS)
    )


_LAYERS: dict[tuple[str, str, str, str], DataFrame] = {}


def layer(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A stored layer: built once per application and state of the input folder, then only read."""
    key = (spark.sparkContext.applicationId, sf_dir, source_version(spark, sf_dir), name)
    if key not in _LAYERS:
        _LAYERS[key] = stored(spark, build(spark, sf_dir), name)
    return _LAYERS[key]


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "bars", bars)


BARS_SQL = """
bars AS (
  SELECT ticker, trading_date,
         min_by(price, trade) AS open_price, max(price) AS high_price,
         min(price) AS low_price, max_by(price, trade) AS close_price,
         CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM (SELECT upper(replace(p_brand, '#', '.')) AS ticker, l_shipdate AS trading_date,
               l_quantity, l_extendedprice / l_quantity AS price,
               struct_pack(o := l_orderkey, l := l_linenumber, p := l_partkey) AS trade
        FROM lineitem JOIN part ON l_partkey = p_partkey) t
  GROUP BY ticker, trading_date)
"""


def brand_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company names for the brands; the last five brands are left out on purpose."""
    brands = (
        table(spark, sf_dir, "part")
        .groupBy("p_brand")
        .agg(F.min("p_type").alias("sector"), F.min("p_name").alias("name"))
    )
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    return brands.filter(number <= 20).select(
        F.upper(F.replace("p_brand", F.lit("#"), F.lit("."))).alias("ticker"),
        "name",
        F.element_at(F.array(F.lit("HOSE"), F.lit("HNX"), F.lit("UPCOM")), number % 3 + 1).alias("market"),
        "sector",
    )


BRAND_UNIVERSE_SQL = r"""
universe AS (
  SELECT upper(replace(p_brand, '#', '.')) AS ticker, min(p_name) AS name,
         CASE CAST(regexp_extract(p_brand, '(\d+)$', 1) AS INT) % 3
              WHEN 0 THEN 'HOSE' WHEN 1 THEN 'HNX' ELSE 'UPCOM' END AS market,
         min(p_type) AS sector
  FROM part
  WHERE CAST(regexp_extract(p_brand, '(\d+)$', 1) AS INT) <= 20
  GROUP BY p_brand)
"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company master: one row per customer, exchange = region, industry = segment."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    segment = F.col("c_mktsegment")
    industry = (
        F.when(segment == "BUILDING", "Ngân hàng")
        .when(segment == "HOUSEHOLD", "Financial Services")
        .otherwise(segment)
    )
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("ordinal"),
            F.concat(F.lit("C"), "c_custkey").alias("ticker"),
            F.col("c_name").alias("name"),
            F.col("r_name").alias("exchange"),
            industry.alias("industry"),
        )
    )


COMPANIES_SQL = """
companies AS (
  SELECT c_custkey AS ordinal, 'C' || c_custkey AS ticker, c_name AS name,
         r_name AS exchange,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'Ngân hàng'
              WHEN 'HOUSEHOLD' THEN 'Financial Services' ELSE c_mktsegment END AS industry
  FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey)
"""

ITEMS = [
    "total_assets",
    "current_assets",
    "current_liabilities",
    "long_term_debt",
    "inventory",
    "cogs",
    "total_liabilities",
    "equity",
    "retained_earnings",
    "net_revenue",
    "ebit",
    "net_profit",
    "interest_expense",
    "operating_cash_flow",
    "market_cap",
]


def _statements(spark: SparkSession, sf_dir: str, period: dict[str, Column]) -> DataFrame:
    """Items per company and period, from the sums of each order.

    Lines are summed per order before they meet the orders, in part on the map side: the join
    sorts one row per order, not one per line. An order that comes twice counts twice.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", *[e.cast("int").alias(n) for n, e in period.items()]
    )
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_orderkey").isNotNull())
    amount = F.col("l_extendedprice")
    kept = amount * (1 - F.col("l_discount"))
    sums = lines.groupBy("l_orderkey").agg(
        F.sum(amount).alias("gross"),
        F.sum(F.when(F.col("l_returnflag") != "R", kept).otherwise(0.0)).alias("net_revenue"),
        F.sum(F.when(F.col("l_returnflag") == "R", amount).otherwise(0.0)).alias("returned"),
        F.sum(amount * F.col("l_tax")).alias("taxamt"),
        F.sum(F.when(F.col("l_linestatus") == "O", amount).otherwise(0.0)).alias("open_amt"),
        F.count("*").alias("n"),
    )
    digits = {"gross": 2, "net_revenue": 4, "returned": 2, "taxamt": 4, "open_amt": 2}
    base = (
        sums.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", *period)
        .agg(*[F.round(F.sum(c), d).alias(c) for c, d in digits.items()], F.sum("n").alias("n"))
    )
    gross, revenue, returned = F.col("gross"), F.col("net_revenue"), F.col("returned")
    tax, unpaid = F.col("taxamt"), F.col("open_amt")
    return base.select(
        F.concat(F.lit("C"), "o_custkey").alias("ticker"),
        *period,
        (gross * 1.5).alias("total_assets"),
        (gross * 0.4 + unpaid * 0.5).alias("current_assets"),
        (gross * 0.3 + returned * 0.6).alias("current_liabilities"),
        (gross * 0.2).alias("long_term_debt"),
        (gross * 0.1).alias("inventory"),
        (gross * 0.3).alias("cogs"),
        (gross * 0.5 + returned * 1.1).alias("total_liabilities"),
        (gross * 1.0 - returned * 1.1).alias("equity"),
        (revenue - gross * 0.3).alias("retained_earnings"),
        revenue.alias("net_revenue"),
        (revenue - gross * 0.4).alias("ebit"),
        ((revenue - gross * 0.4) * 0.8 - tax * 0.5).alias("net_profit"),
        F.when(F.col("n") % 7 == 0, 0.0).otherwise(tax * 0.5).alias("interest_expense"),
        (revenue - gross * 0.5 - unpaid * 0.1).alias("operating_cash_flow"),
        (gross * 2.0 - returned * 1.5).alias("market_cap"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly statement items, one row per (company, year)."""
    return _statements(spark, sf_dir, {"year": F.year("o_orderdate")})


def quarterly_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statements(
        spark, sf_dir, {"year": F.year("o_orderdate"), "quarter": F.quarter("o_orderdate")}
    )


def _statements_sql(name: str, period: dict[str, str]) -> str:
    listed = ", ".join(f"CAST({e} AS INT) AS {n}" for n, e in period.items())
    names = ", ".join(period)
    return f"""
{name} AS (
  SELECT 'C' || o_custkey AS ticker, {names},
    gross * 1.5 AS total_assets, gross * 0.4 + open_amt * 0.5 AS current_assets,
    gross * 0.3 + returned * 0.6 AS current_liabilities, gross * 0.2 AS long_term_debt,
    gross * 0.1 AS inventory, gross * 0.3 AS cogs,
    gross * 0.5 + returned * 1.1 AS total_liabilities,
    gross * 1.0 - returned * 1.1 AS equity,
    net_revenue - gross * 0.3 AS retained_earnings, net_revenue,
    net_revenue - gross * 0.4 AS ebit,
    (net_revenue - gross * 0.4) * 0.8 - taxamt * 0.5 AS net_profit,
    CASE WHEN n % 7 = 0 THEN 0.0 ELSE taxamt * 0.5 END AS interest_expense,
    net_revenue - gross * 0.5 - open_amt * 0.1 AS operating_cash_flow,
    gross * 2.0 - returned * 1.5 AS market_cap
  FROM (SELECT o_custkey, {listed},
      round(sum(l_extendedprice), 2) AS gross,
      round(sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0 END), 4) AS net_revenue,
      round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS returned,
      round(sum(l_extendedprice * l_tax), 4) AS taxamt,
      round(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END), 2) AS open_amt,
      count(*) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    GROUP BY o_custkey, {", ".join(period.values())}) b)
"""


STATEMENTS_SQL = _statements_sql("statements", {"year": "year(o_orderdate)"})
QUARTERLY_SQL = _statements_sql(
    "quarterly", {"year": "year(o_orderdate)", "quarter": "quarter(o_orderdate)"}
)
