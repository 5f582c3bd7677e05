"""Statement, ratio and distress-label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.aliases import METRIC_ALIASES
from ledgerline.operators import indicators as ind
from ledgerline.operators import labels, ratios
from ledgerline.operators import statements as st
from ledgerline.plans.inputs import (
    BARS_SQL,
    ITEMS,
    QUARTERLY_SQL,
    STATEMENTS_SQL,
    companies,
    layer,
    stored_bars,
    table,
)
from ledgerline.plans.inputs import COMPANIES_SQL
from ledgerline.plans.inputs import quarterly_statements as build_quarterly
from ledgerline.plans.inputs import statements as build_statements
from ledgerline.plans.market import FEATURE_PARTS, FEATURES_SQL
from ledgerline.plans.registry import Catalog, with_parts
from ledgerline.session import configure, work_dir

fundamentals = Catalog()


def statements(spark, sf_dir):
    return layer(spark, sf_dir, "statements", build_statements)


def quarterly(spark, sf_dir):
    return layer(spark, sf_dir, "quarterly", build_quarterly)


def _build_ratios(spark, sf_dir):
    return ratios.ratios(statements(spark, sf_dir))


def stored_ratios(spark, sf_dir):
    return layer(spark, sf_dir, "ratios", _build_ratios)


# ---------------------------------------------------------------- shapes and names

LONG_SQL = f"""
long_items AS (UNPIVOT statements ON {", ".join(ITEMS)} INTO NAME metric_code VALUE value)
"""


@fundamentals.query(
    "statement_long", with_parts(STATEMENTS_SQL, LONG_SQL, body="SELECT * FROM long_items")
)
def statement_long(spark, sf_dir):
    return st.to_long(statements(spark, sf_dir), ["ticker", "year"], ITEMS)


@fundamentals.query("statement_pivot", with_parts(STATEMENTS_SQL, body="SELECT * FROM statements"))
def statement_pivot(spark, sf_dir):
    long = st.to_long(statements(spark, sf_dir), ["ticker", "year"], ITEMS)
    return st.to_wide(long, ["ticker", "year"], ITEMS)


_KINDS_SQL = (
    "CASE "
    + " ".join(f"WHEN metric_code = '{k}' THEN '{kind}'" for k, kind, _ in METRIC_ALIASES)
    + " WHEN metric_code = 'long_term_debt' THEN 'BS' WHEN metric_code = 'cogs' THEN 'IS' END"
)


_NAMES_SQL = """upper(replace(metric_code, '_', ' ')) AS metric_name, metric_code[1] || '-items' AS category"""


def _report_items(spark, sf_dir, source, period, kind: str):
    """Items as a report holds them: with name, unit and category."""
    ids = ["ticker", "year", "quarter"] if "quarter" in source.columns else ["ticker", "year"]
    long = st.to_long(st.by_company(source), ids, ITEMS)
    return long.select(
        "ticker",
        F.lit(kind).alias("period_type"),
        st.statement_kind(F.col("metric_code")).alias("statement"),
        "metric_code",
        F.upper(F.replace("metric_code", F.lit("_"), F.lit(" "))).alias("metric_name"),
        F.lit("VND").alias("unit"),
        F.concat(F.substring("metric_code", 1, 1), F.lit("-items")).alias("category"),
        period.alias("period"),
        "value",
    ).filter(F.col("statement") != "MARKET")


def _landed_reports(spark, sf_dir):
    """Yearly and quarterly reports of all companies, landed as nested JSON and read back.

    A report is of one kind, so either kind is grouped by itself; the text repeats the names of
    items in every report and is packed.
    """
    path = work_dir(configure(spark), "reports")
    yearly = _report_items(spark, sf_dir, statements(spark, sf_dir), F.col("year").cast("string"), "YEARLY")
    name = F.concat(F.col("year").cast("string"), F.lit("Q"), F.col("quarter").cast("string"))
    by_quarter = _report_items(spark, sf_dir, quarterly(spark, sf_dir), name, "QUARTERLY")
    st.to_reports(yearly).unionByName(st.to_reports(by_quarter)).write.json(path, compression="gzip")
    return spark.read.schema(st.REPORT_SCHEMA).json(path)


@fundamentals.query(
    "statement_scan",
    with_parts(
        STATEMENTS_SQL,
        LONG_SQL,
        body=f"""SELECT ticker, 'YEARLY' AS period_type, {_KINDS_SQL} AS statement, metric_code, {_NAMES_SQL}, 'VND' AS unit,
                        CAST(year AS VARCHAR) AS period, value
                 FROM long_items WHERE metric_code <> 'market_cap'""",
    ),
)
def statement_scan(spark, sf_dir):
    """The yearly items of all companies out of nested reports."""
    reports = _landed_reports(spark, sf_dir)
    return st.from_reports(reports.filter(F.col("period_type") == "YEARLY"))


@fundamentals.query(
    "header_rows",
    with_parts(
        STATEMENTS_SQL,
        LONG_SQL,
        body="""SELECT *, metric_name = upper(metric_name) AS is_header FROM (
                  SELECT ticker, year, metric_code, CASE WHEN metric_code LIKE 'total%' THEN upper(replace(metric_code, '_', ' '))
                         WHEN year % 2 = 0 THEN CAST(year AS VARCHAR) ELSE replace(metric_code, '_', ' ') END AS metric_name
                  FROM long_items) n""",
    ),
)
def header_rows(spark, sf_dir):
    """Totals are header rows of a statement, and so are names without any letter."""
    code = F.replace("metric_code", F.lit("_"), F.lit(" "))
    name = F.when(F.col("metric_code").startswith("total"), F.upper(code)).when(
        F.col("year") % 2 == 0, F.col("year").cast("string")
    )
    items = statement_long(spark, sf_dir).withColumn("metric_name", F.coalesce(name, code))
    return items.select("ticker", "year", "metric_code", "metric_name", st.is_header("metric_name").alias("is_header"))


@fundamentals.query(
    "report_periods",
    with_parts(
        STATEMENTS_SQL,
        LONG_SQL,
        body="""SELECT ticker, metric_code, array_to_string(list_sort(list(CAST(year AS VARCHAR))), ',') AS periods,
                       max_by(value, year) AS last_value
                FROM long_items WHERE metric_code <> 'market_cap' AND value IS NOT NULL GROUP BY ticker, metric_code""",
    ),
)
def report_periods(spark, sf_dir):
    """Period map lookups on every item of the nested reports."""
    reports = _landed_reports(spark, sf_dir).filter(F.col("period_type") == "YEARLY")
    items = F.concat(*[F.transform(part, lambda i: i) for part in st.REPORT_PARTS])
    each = reports.select("ticker", "periods", F.explode(items).alias("item"))
    return each.select(
        "ticker",
        "item.metric_code",
        F.array_join(F.array_sort(F.map_keys("item.values")), ",").alias("periods"),
        F.try_element_at("item.values", F.array_max(F.map_keys("item.values"))).alias("last_value"),
    )


@fundamentals.query(
    "quarterly_filter",
    with_parts(
        QUARTERLY_SQL,
        body="""SELECT ticker, CAST(year AS VARCHAR) || 'Q' || CAST(quarter AS VARCHAR) AS period, net_revenue, net_profit
                FROM quarterly""",
    ),
)
def quarterly_filter(spark, sf_dir):
    """Income items of quarterly reports; yearly reports and other statements stay out."""
    chosen = st.report_items(_landed_reports(spark, sf_dir), "IS", "QUARTERLY")
    return st.to_wide(chosen, ["ticker", "period"], ["net_revenue", "net_profit"])


# Every item under one of its reported names, the spelling varying by company.
_NAMES = {key: aliases for key, _, aliases in METRIC_ALIASES}
_NAMED_SQL = (
    "CASE metric_code "
    + " ".join(
        f"WHEN '{k}' THEN list_extract([{', '.join(repr(a) for a in names)}], "
        f"CAST(CAST(substr(ticker, 2) AS BIGINT) % {len(names)} + 1 AS INT))"
        for k, names in _NAMES.items()
    )
    + " ELSE 'raw ' || metric_code END"
)


def reported_items(spark, sf_dir):
    long = st.to_long(statements(spark, sf_dir), ["ticker", "year"], ITEMS)
    spellings = spark.createDataFrame(
        [(k, i, len(names), n) for k, names in _NAMES.items() for i, n in enumerate(names)],
        "metric_code string, nth int, spellings int, reported string",
    )
    number = F.substring("ticker", 2, 20).cast("bigint")
    # The spelling list is the fixed alias table again: a few dozen rows.
    named = long.join(
        F.broadcast(spellings),
        (long.metric_code == spellings.metric_code) & (number % F.col("spellings") == F.col("nth")),
        "left",
    ).select("ticker", "year", long.metric_code, "value", "reported")
    plain = F.coalesce("reported", F.concat(F.lit("raw "), F.col("metric_code")))
    return named.select(
        "ticker",
        "year",
        plain.alias("plain_name"),
        F.concat(F.lit("  "), F.upper(plain), F.lit(" ")).alias("metric_name"),
        "value",
    )


@fundamentals.query(
    "metric_alias_join",
    with_parts(
        STATEMENTS_SQL,
        LONG_SQL,
        body=f"""SELECT ticker, year, {_NAMED_SQL} AS plain_name, value,
                        CASE WHEN metric_code IN ({", ".join(repr(k) for k in _NAMES)}) THEN metric_code END AS standard_key
                 FROM long_items""",
    ),
)
def metric_alias_join(spark, sf_dir):
    mapped = st.map_metrics(reported_items(spark, sf_dir), st.alias_table(spark))
    return mapped.select("ticker", "year", "plain_name", "value", "standard_key")


@fundamentals.query(
    "unmapped_metrics",
    with_parts(
        STATEMENTS_SQL,
        LONG_SQL,
        body="""SELECT 'raw ' || metric_code AS plain_name, count(*) AS items FROM long_items
                WHERE metric_code IN ('long_term_debt', 'market_cap') GROUP BY metric_code""",
    ),
)
def unmapped_metrics(spark, sf_dir):
    """What stays unknown after an alias for cost of goods sold has been added."""
    aliases = st.alias_table(spark, [("  Raw COGS ", "cogs"), (" ", "cogs")])
    mapped = st.map_metrics(reported_items(spark, sf_dir), aliases)
    return mapped.filter(F.col("standard_key").isNull()).groupBy("plain_name").agg(F.count("*").alias("items"))


@fundamentals.query(
    "unit_convert",
    with_parts(
        STATEMENTS_SQL,
        LONG_SQL,
        body="""SELECT ticker, year, metric_code, CASE WHEN year % 5 < 4 THEN 'BILLION_VND' END AS unit,
                       CASE year % 5 WHEN 0 THEN value * 1e0 / 1e9 WHEN 1 THEN value * 1e3 / 1e9
                            WHEN 2 THEN value * 1e6 / 1e9 WHEN 3 THEN value * 1e9 / 1e9 END AS value
                FROM long_items""",
    ),
)
def unit_convert(spark, sf_dir):
    units = F.array(*[F.lit(u) for u in ["VND", "THOUSAND_VND", "MILLION_VND", "BILLION_VND", "POINTS"]])
    long = st.to_long(statements(spark, sf_dir), ["ticker", "year"], ITEMS)
    tagged = long.withColumn("unit", F.element_at(units, F.col("year") % 5 + 1))
    return st.convert_units(tagged)


# ---------------------------------------------------------------- gaps and outliers

# Items go missing by a fixed pattern; every seventeenth company loses most of them.
def _gap(i: int, item: str) -> str:
    most = f" OR (ck % 17 = 3 AND year % 2 = 0 AND {i} < 10)"
    return f"CASE WHEN (ck * 7 + year * 3 + {i} * 5) % 23 = 0{most} THEN NULL ELSE {item} END AS {item}"


GAPPED_SQL = (
    "gapped AS (SELECT ticker, year, "
    + ", ".join(_gap(i, item) for i, item in enumerate(ITEMS))
    + " FROM (SELECT *, CAST(substr(ticker, 2) AS BIGINT) AS ck FROM statements) s)"
)


def gapped(spark, sf_dir):
    """The number of a company is read from its ticker once per row, not once per item."""
    numbered = statements(spark, sf_dir).withColumn("_ck", F.substring("ticker", 2, 20).cast("bigint"))
    ck, year = F.col("_ck"), F.col("year")
    out = []
    for i, item in enumerate(ITEMS):
        gone = (ck * 7 + year * 3 + i * 5) % 23 == 0
        if i < 10:
            gone = gone | ((ck % 17 == 3) & (year % 2 == 0))
        out.append(F.when(~gone, F.col(item)).alias(item))
    return numbered.select("ticker", "year", *out)


@fundamentals.query(
    "missing_report",
    with_parts(
        STATEMENTS_SQL,
        GAPPED_SQL,
        body="""
        SELECT metric_code, missing_count, missing_pct,
               CASE WHEN missing_pct = 0 THEN 'none' WHEN missing_pct <= 5 THEN 'low' ELSE 'high' END AS severity
        FROM (
        """
        + " UNION ALL ".join(
            f"SELECT '{i}' AS metric_code, count(*) - count({i}) AS missing_count, round((count(*) - count({i})) * 100.0 / count(*), 4) AS missing_pct FROM gapped"
            for i in ITEMS
        )
        + " UNION ALL SELECT 'ALL', "
        + " + ".join(f"(count(*) - count({i}))" for i in ITEMS)
        + ", round(("
        + " + ".join(f"(count(*) - count({i}))" for i in ITEMS)
        + f") * 100.0 / (count(*) * {len(ITEMS)}), 4) FROM gapped) r",
    ),
)
def missing_report(spark, sf_dir):
    return st.missing_report(gapped(spark, sf_dir), ITEMS)


_MISSING_SQL = " + ".join(f"CASE WHEN {i} IS NULL THEN 1 ELSE 0 END" for i in ITEMS)


@fundamentals.query(
    "missing_policy",
    with_parts(
        STATEMENTS_SQL,
        GAPPED_SQL,
        body=f"""SELECT ticker, year, CAST(m AS INT) AS missing_items FROM (SELECT ticker, year, {_MISSING_SQL} AS m FROM gapped) g
                 WHERE m <= {len(ITEMS) / 2}""",
    ),
)
def missing_policy(spark, sf_dir):
    return st.drop_sparse(gapped(spark, sf_dir), ITEMS).select("ticker", "year", "missing_items")


@fundamentals.query(
    "negative_check",
    with_parts(
        STATEMENTS_SQL,
        body="SELECT ticker, year, concat_ws(',', "
        + ", ".join(f"CASE WHEN {c} - 60000 < 0 THEN '{c}' END" for c in st.NOT_NEGATIVE)
        + ") AS negative_items FROM statements",
    ),
)
def negative_check(spark, sf_dir):
    """All items that must not be negative, shifted so that each of them is at times."""
    shifted = statements(spark, sf_dir).withColumns({c: F.col(c) - 60000 for c in st.NOT_NEGATIVE})
    flagged = st.negative_flags(shifted)
    return flagged.select("ticker", "year", F.array_join("negative_items", ",").alias("negative_items"))


RUNS_SQL = """
runs AS (
  SELECT ticker, max(run) AS longest_run FROM (
    SELECT ticker, count(*) AS run FROM (
      SELECT ticker, year - row_number() OVER (PARTITION BY ticker ORDER BY year) AS island FROM statements) i
    GROUP BY ticker, island) r GROUP BY ticker)
"""


@fundamentals.query(
    "min_history",
    with_parts(
        STATEMENTS_SQL,
        RUNS_SQL,
        body="SELECT ticker, year FROM statements WHERE ticker IN (SELECT ticker FROM runs WHERE longest_run >= 5)",
    ),
)
def min_history(spark, sf_dir):
    return st.min_history(statements(spark, sf_dir)).select("ticker", "year")


@fundamentals.query(
    "qualification",
    with_parts(
        STATEMENTS_SQL,
        RUNS_SQL,
        body="""SELECT count(*) AS total_companies, count(*) FILTER (WHERE longest_run >= 5) AS qualified_companies,
                       count(*) FILTER (WHERE longest_run < 5) AS rejected_companies FROM runs""",
    ),
)
def qualification(spark, sf_dir):
    return st.qualification(statements(spark, sf_dir))


# ---------------------------------------------------------------- ratios


def _sql_ratio(n: str, d: str, scale: str = "") -> str:
    return f"({n}) / nullif({d}, 0){scale}"


_PREV = "CASE WHEN lag(year) OVER w = year - 1 THEN lag({0}) OVER w END"
_LIQUIDITY = {
    "current_ratio": _sql_ratio("current_assets", "current_liabilities"),
    "working_capital_to_ta": _sql_ratio("current_assets - current_liabilities", "total_assets"),
    "ocf_to_current_liabilities": _sql_ratio("operating_cash_flow", "current_liabilities"),
}
_PROFITABILITY = {
    "roa": _sql_ratio("net_profit", "total_assets", " * 100"),
    "roe": _sql_ratio("net_profit", "equity", " * 100"),
    "ebit_margin": _sql_ratio("ebit", "net_revenue", " * 100"),
    "ebit_to_ta": _sql_ratio("ebit", "total_assets", " * 100"),
    "asset_turnover": _sql_ratio("net_revenue", "total_assets"),
}
_LEVERAGE = {
    "short_term_debt_to_ta": _sql_ratio("current_liabilities", "total_assets"),
    "long_term_debt_to_ta": _sql_ratio("long_term_debt", "total_assets"),
    "debt_to_ta": _sql_ratio("total_liabilities", "total_assets"),
}
_SIZE_GROWTH = {
    "log_total_assets": "CASE WHEN total_assets > 0 THEN log10(total_assets) END",
    "asset_growth": "(total_assets - prev_assets) / nullif(prev_assets, 0) * 100",
    "profit_growth": "(net_profit - prev_profit) / nullif(abs(prev_profit), 0) * 100",
    "market_cap": "market_cap",
    "market_equity_to_debt": _sql_ratio("market_cap", "total_liabilities"),
}
_ALL_RATIOS = {**_LIQUIDITY, **_PROFITABILITY, **_LEVERAGE, **_SIZE_GROWTH}


def _select(columns: dict[str, str]) -> str:
    """Four decimals each, without a negative zero."""
    return ", ".join(
        f"CASE WHEN abs({e}) < 0.00005e0 THEN 0e0 ELSE round({e}, 4) END AS {n}"
        for n, e in columns.items()
    )


RATIOS_SQL = f"""
lagged AS (
  SELECT *, {_PREV.format("total_assets")} AS prev_assets, {_PREV.format("net_profit")} AS prev_profit,
         {_PREV.format("operating_cash_flow")} AS prev_ocf
  FROM statements WINDOW w AS (PARTITION BY ticker ORDER BY year)),
ratios AS (SELECT ticker, year, {_select(_ALL_RATIOS)} FROM lagged)
"""


def _ratio_query(name: str, columns: list[str]) -> None:
    listed = ", ".join(columns)

    @fundamentals.query(
        name, with_parts(STATEMENTS_SQL, RATIOS_SQL, body=f"SELECT ticker, year, {listed} FROM ratios")
    )
    def run(spark, sf_dir):
        return ratios.ratios(statements(spark, sf_dir)).select("ticker", "year", *columns)


_ratio_query("liquidity", ratios.LIQUIDITY)
_ratio_query("profitability", ratios.PROFITABILITY)
_ratio_query("leverage", ratios.LEVERAGE)
_ratio_query("size_growth", ratios.SIZE_GROWTH)
_ratio_query("asset_growth", ["asset_growth"])
_ratio_query("profit_growth", ["profit_growth"])
_ratio_query("ratios", ratios.RATIOS)


MARKET_COLUMNS = ["sharpe_ratio", "rsi_14", "macd", "macd_signal", "adx_14", "cci_14"]


@fundamentals.query(
    "ratio_table",
    with_parts(
        STATEMENTS_SQL,
        RATIOS_SQL,
        # These begin with the bars that the market queries share.
        *FEATURE_PARTS,
        f"features AS ({FEATURES_SQL})",
        body=f"""
        SELECT r.ticker, r.year, {", ".join(f"r.{c}" for c in ratios.RATIOS)}, {", ".join(f"f.{c}" for c in MARKET_COLUMNS)}
        FROM ratios r LEFT JOIN features f
        ON f.ticker = 'BRAND.' || (CAST(substr(r.ticker, 2) AS BIGINT) % 25 + 1) AND f.year = r.year""",
        recursive=True,
    ),
)
def ratio_table(spark, sf_dir):
    """The whole table of a company's year: 16 accounting ratios and the 6 market columns of its share."""
    market = ind.market_features(stored_bars(spark, sf_dir)).withColumnRenamed("ticker", "brand")
    brand = F.concat(F.lit("BRAND."), F.substring("ticker", 2, 20).cast("bigint") % 25 + 1)
    rows = stored_ratios(spark, sf_dir).withColumn("brand", brand)
    joined = rows.join(market.select("brand", "year", *MARKET_COLUMNS), ["brand", "year"], "left")
    return joined.select("ticker", "year", *ratios.RATIOS, *MARKET_COLUMNS)


@fundamentals.query(
    "safe_ratio",
    with_parts(
        STATEMENTS_SQL,
        body="SELECT ticker, year, round(ebit / nullif(interest_expense, 0), 4) AS interest_cover FROM statements",
    ),
)
def safe_ratio(spark, sf_dir):
    cover = ratios.ratio(F.col("ebit"), F.col("interest_expense"))
    return statements(spark, sf_dir).select("ticker", "year", F.round(cover, 4).alias("interest_cover"))


WINSORIZED = list(ratios.RATIOS)
_BOUNDS_SQL = (
    "bounds AS (SELECT "
    + ", ".join(
        f"quantile_cont({m}, 0.01) AS {m}_lo, quantile_cont({m}, 0.99) AS {m}_hi" for m in WINSORIZED
    )
    + " FROM ratios)"
)


@fundamentals.query(
    "winsorize",
    with_parts(
        STATEMENTS_SQL,
        RATIOS_SQL,
        _BOUNDS_SQL,
        body="SELECT ticker, year, "
        + ", ".join(
            f"round(CASE WHEN {m} IS NOT NULL THEN greatest(least({m}, {m}_hi), {m}_lo) END, 4) AS {m}"
            for m in WINSORIZED
        )
        + " FROM ratios, bounds",
    ),
)
def winsorize(spark, sf_dir):
    rows = stored_ratios(spark, sf_dir).select("ticker", "year", *WINSORIZED)
    treated = st.winsorize(rows, st.winsor_bounds(rows, WINSORIZED))
    return treated.select("ticker", "year", *[F.round(m, 4).alias(m) for m in WINSORIZED])


@fundamentals.query(
    "outlier_log",
    with_parts(
        STATEMENTS_SQL,
        RATIOS_SQL,
        _BOUNDS_SQL,
        body=" UNION ALL ".join(
            f"""SELECT ticker, '{m}' AS metric, year, {m} AS raw_value,
                       round(CASE WHEN {m} < {m}_lo THEN {m}_lo ELSE {m}_hi END, 4) AS treated_value,
                       CASE WHEN {m} < {m}_lo THEN 'RAISED_TO_LOW' ELSE 'CUT_TO_HIGH' END AS action
                FROM ratios, bounds WHERE {m} < {m}_lo OR {m} > {m}_hi"""
            for m in WINSORIZED
        ),
    ),
)
def outlier_log(spark, sf_dir):
    rows = stored_ratios(spark, sf_dir).select("ticker", "year", *WINSORIZED)
    log = st.outlier_log(rows, st.winsor_bounds(rows, WINSORIZED))
    return log.withColumn("treated_value", F.round("treated_value", 4))


# ---------------------------------------------------------------- scores and labels

_X = {
    "x1": "(current_assets - current_liabilities) / nullif(total_assets, 0)",
    "x2": "retained_earnings / nullif(total_assets, 0)",
    "x3": "ebit / nullif(total_assets, 0)",
    "x4": "market_cap / nullif(total_liabilities, 0)",
    "x5": "net_revenue / nullif(total_assets, 0)",
}
_Z = "1.2e0 * x1 + 1.4e0 * x2 + 3.3e0 * x3 + 0.6e0 * x4 + 0.999e0 * x5"


def _zone(z: str, safe: float = 2.99, distress: float = 1.81) -> str:
    return f"CASE WHEN {z} > {safe}e0 THEN 'SAFE' WHEN {z} < {distress}e0 THEN 'DISTRESS' WHEN {z} IS NOT NULL THEN 'GREY' END"


SCORED_SQL = f"""
components AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _X.items())} FROM lagged),
scored AS (SELECT *, {_Z} AS z_score FROM components),
zoned AS (SELECT *, {_zone("z_score")} AS zone FROM scored)
"""
LABELLED_SQL = """
flagged AS (
  SELECT *, coalesce(net_profit < 0 AND prev_profit < 0, false) AS R1, coalesce(equity < 0, false) AS R2,
         coalesce(retained_earnings < 0, false) AS R3, coalesce(interest_expense > 0 AND ebit < interest_expense, false) AS R4,
         coalesce(operating_cash_flow < 0 AND prev_ocf < 0, false) AS R5,
         coalesce(current_liabilities > current_assets, false) AS R6
  FROM zoned),
counted AS (
  SELECT *, CAST(R1 AS INT) + CAST(R2 AS INT) + CAST(R3 AS INT) + CAST(R4 AS INT) + CAST(R5 AS INT) + CAST(R6 AS INT) AS rules_fired
  FROM flagged),
labelled AS (
  SELECT *, CASE WHEN rules_fired >= 2 OR z_score < 1.81e0 THEN 1 ELSE 0 END AS distress_label,
         CASE WHEN rules_fired >= 2 OR z_score < 1.81e0 THEN 'DISTRESS' WHEN zone = 'GREY' OR rules_fired = 1 THEN 'WARNING' ELSE 'SAFE' END AS distress_status
  FROM counted)
"""
LABEL_PARTS = [STATEMENTS_SQL, RATIOS_SQL, SCORED_SQL, LABELLED_SQL]


@fundamentals.query(
    "altman_z",
    with_parts(
        STATEMENTS_SQL,
        RATIOS_SQL,
        SCORED_SQL,
        body=f"SELECT ticker, year, {_select({x: x for x in [*_X, 'z_score']})} FROM scored",
    ),
)
def altman_z(spark, sf_dir):
    scored = ratios.altman(statements(spark, sf_dir))
    return scored.select("ticker", "year", *[F.round(c, 4).alias(c) for c in [*_X, "z_score"]])


@fundamentals.query(
    "z_zone",
    with_parts(
        STATEMENTS_SQL,
        RATIOS_SQL,
        SCORED_SQL,
        body="""SELECT ticker, year, zone, CASE zone WHEN 'SAFE' THEN 'low' WHEN 'GREY' THEN 'medium' WHEN 'DISTRESS' THEN 'high' END AS risk
                FROM zoned""",
    ),
)
def z_zone(spark, sf_dir):
    scored = ratios.altman(statements(spark, sf_dir))
    return scored.select("ticker", "year", "zone", ratios.zone_risk(F.col("zone")).alias("risk"))


_ZE = "3.25e0 + 6.56e0 * x1 + 3.26e0 * x2 + 6.72e0 * x3 + 1.05e0 * (equity / nullif(total_liabilities, 0))"


@fundamentals.query(
    "z_variants",
    with_parts(
        STATEMENTS_SQL,
        RATIOS_SQL,
        SCORED_SQL,
        f"both_scores AS (SELECT 'original' AS variant, z_score AS z, zone FROM zoned UNION ALL SELECT 'emerging', ze, {_zone('ze', 5.85, 4.15)} FROM (SELECT *, {_ZE} AS ze FROM components) e)",
        body="SELECT variant, zone, CAST(floor(z) AS BIGINT) AS z_bin, count(*) AS rows FROM both_scores GROUP BY ALL",
    ),
)
def z_variants(spark, sf_dir):
    return ratios.z_variants(statements(spark, sf_dir))


@fundamentals.query(
    "distress_rules",
    with_parts(
        *LABEL_PARTS,
        body="SELECT ticker, year, R1, R2, R3, R4, R5, R6, CAST(rules_fired AS INT) AS rules_fired FROM counted",
    ),
)
def distress_rules(spark, sf_dir):
    flagged = labels.with_rules(statements(spark, sf_dir))
    return flagged.select("ticker", "year", *labels.RULES, "rules_fired")


@fundamentals.query(
    "distress_label",
    with_parts(
        *LABEL_PARTS,
        body="""SELECT ticker, year, CAST(CASE WHEN rules_fired >= 2 THEN 1 ELSE 0 END AS INT) AS rule_based,
                       CAST(CASE WHEN z_score < 1.81e0 THEN 1 ELSE 0 END AS INT) AS z_based, CAST(distress_label AS INT) AS hybrid
                FROM labelled""",
    ),
)
def distress_label(spark, sf_dir):
    judged = ratios.altman(labels.with_rules(statements(spark, sf_dir)))
    return judged.select(
        "ticker",
        "year",
        labels.label("RULE_BASED").alias("rule_based"),
        labels.label("Z_SCORE").alias("z_based"),
        labels.label("HYBRID").alias("hybrid"),
    )


@fundamentals.query(
    "distress_status",
    with_parts(
        *LABEL_PARTS,
        body="""SELECT ticker, year, distress_status, zone,
                       concat_ws(',', CASE WHEN R1 THEN 'R1' END, CASE WHEN R2 THEN 'R2' END, CASE WHEN R3 THEN 'R3' END,
                                 CASE WHEN R4 THEN 'R4' END, CASE WHEN R5 THEN 'R5' END, CASE WHEN R6 THEN 'R6' END) AS fired
                FROM labelled""",
    ),
)
def distress_status(spark, sf_dir):
    judged = labels.distress_labels(statements(spark, sf_dir))
    fired = F.filter(labels.rule_checks(), lambda r: r["triggered"])
    codes = F.array_join(F.transform(fired, lambda r: r["rule_code"]), ",")
    return judged.select("ticker", "year", "distress_status", "zone", codes.alias("fired"))


@fundamentals.query(
    "label_agreement",
    with_parts(
        *LABEL_PARTS,
        body="""SELECT CAST(CASE WHEN rules_fired >= 2 THEN 1 ELSE 0 END AS INT) AS rule_label,
                       CAST(CASE WHEN z_score < 1.81e0 THEN 1 ELSE 0 END AS INT) AS z_label, count(*) AS rows
                FROM labelled GROUP BY 1, 2""",
    ),
)
def label_agreement(spark, sf_dir):
    return labels.label_agreement(statements(spark, sf_dir))


SHOCKS = {"base": {}, "debt_x2": {"total_liabilities": 2.0}, "sales_down": {"net_revenue": 0.7, "ebit": 0.5}}


def _shocked(name: str, factors: dict) -> str:
    columns = ["current_assets", "current_liabilities", "total_assets", "retained_earnings", "market_cap"]
    scaled = {"total_liabilities": 1.0, "net_revenue": 1.0, "ebit": 1.0, **factors}
    items = ", ".join(columns + [f"{c} * {f}e0 AS {c}" for c, f in scaled.items()])
    return f"SELECT ticker, year, '{name}' AS scenario, {items} FROM statements"


@fundamentals.query(
    "scenario_cross",
    with_parts(
        STATEMENTS_SQL,
        "shocked AS (" + " UNION ALL ".join(_shocked(n, f) for n, f in SHOCKS.items()) + ")",
        f"shocked_x AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _X.items())} FROM shocked)",
        body=f"SELECT ticker, year, scenario, round(z, 4) AS z_score, {_zone('z')} AS zone FROM (SELECT *, {_Z} AS z FROM shocked_x) s",
    ),
)
def scenario_cross(spark, sf_dir):
    shocked = ratios.scenarios(statements(spark, sf_dir), SHOCKS)
    return shocked.withColumn("z_score", F.round("z_score", 4))


# ---------------------------------------------------------------- periods and peers

_QPREV = "CASE WHEN lag(year * 4 + quarter) OVER w = year * 4 + quarter - 1 THEN lag({0}) OVER w END"
_QNEXT = "CASE WHEN lead(year * 4 + quarter) OVER w = year * 4 + quarter + 1 THEN lead({0}) OVER w END"
QLAGGED_SQL = f"""
qlagged AS (
  SELECT *, {_QPREV.format("net_revenue")} AS prev_revenue, {_QPREV.format("net_profit")} AS prev_profit,
         {_QNEXT.format("net_profit")} AS next_profit
  FROM quarterly WINDOW w AS (PARTITION BY ticker ORDER BY year, quarter))
"""


@fundamentals.query(
    "loss_features",
    with_parts(
        QUARTERLY_SQL,
        QLAGGED_SQL,
        body="""SELECT ticker, year, quarter, round(total_liabilities / nullif(total_assets, 0), 4) AS debt_to_assets,
                       round((net_revenue - cogs) / nullif(net_revenue, 0) * 100, 4) AS gross_margin,
                       round((net_revenue - prev_revenue) / nullif(abs(prev_revenue), 0) * 100, 4) AS revenue_growth,
                       round((current_assets - inventory) / nullif(current_liabilities, 0), 4) AS quick_ratio
                FROM qlagged""",
    ),
)
def loss_features(spark, sf_dir):
    return ratios.loss_features(quarterly(spark, sf_dir))


@fundamentals.query(
    "loss_next_period",
    with_parts(
        QUARTERLY_SQL,
        QLAGGED_SQL,
        body="""SELECT ticker, year, quarter, CASE WHEN next_profit IS NOT NULL THEN CAST(next_profit < 0 AS INT) END AS is_loss
                FROM qlagged""",
    ),
)
def loss_next_period(spark, sf_dir):
    return ratios.loss_next_period(quarterly(spark, sf_dir))


@fundamentals.query(
    "loss_dataset",
    with_parts(
        QUARTERLY_SQL,
        QLAGGED_SQL,
        body="""SELECT ticker, year, quarter, round(total_liabilities / nullif(total_assets, 0), 4) AS debt_to_assets,
                       round((net_revenue - cogs) / nullif(net_revenue, 0) * 100, 4) AS gross_margin,
                       round((net_revenue - prev_revenue) / nullif(abs(prev_revenue), 0) * 100, 4) AS revenue_growth,
                       round((current_assets - inventory) / nullif(current_liabilities, 0), 4) AS quick_ratio,
                       CAST(next_profit < 0 AS INT) AS is_loss
                FROM qlagged WHERE next_profit IS NOT NULL""",
    ),
)
def loss_dataset(spark, sf_dir):
    return ratios.loss_dataset(quarterly(spark, sf_dir))


@fundamentals.query(
    "business_results",
    with_parts(
        STATEMENTS_SQL,
        RATIOS_SQL,
        QUARTERLY_SQL,
        QLAGGED_SQL,
        body="""
        SELECT ticker, CAST(year AS VARCHAR) AS period, net_revenue AS revenue, net_profit AS profit,
               round((net_profit - prev_profit) / nullif(abs(prev_profit), 0) * 100, 4) AS growth FROM lagged
        UNION ALL
        SELECT ticker, 'Q' || quarter || '/' || year, net_revenue, net_profit,
               round((net_profit - prev_profit) / nullif(abs(prev_profit), 0) * 100, 4) FROM qlagged""",
    ),
)
def business_results(spark, sf_dir):
    yearly = ratios.business_results(statements(spark, sf_dir))
    return yearly.unionByName(ratios.business_results(quarterly(spark, sf_dir), quarterly=True))


def _peers(spark, sf_dir):
    industry = companies(spark, sf_dir).select("ticker", "industry")
    rows = stored_ratios(spark, sf_dir).join(industry, "ticker")
    return rows.unpivot(["ticker", "industry", "year"], ratios.RATIOS, "metric", "value").filter("value IS NOT NULL")


@fundamentals.query(
    "peer_rank",
    with_parts(
        STATEMENTS_SQL,
        RATIOS_SQL,
        COMPANIES_SQL,
        f"""peers AS (UNPIVOT (SELECT r.ticker, c.industry, r.year, {", ".join(f"r.{c}" for c in ratios.RATIOS)}
                              FROM ratios r JOIN companies c ON c.ticker = r.ticker)
                      ON {", ".join(ratios.RATIOS)} INTO NAME metric VALUE value)""",
        body="""
        SELECT ticker, industry, year, metric, value, count(*) OVER g AS peers,
               round(percent_rank() OVER (PARTITION BY industry, year, metric ORDER BY value), 6) AS percent_rank,
               CAST(sum(CAST(round(value * 10000) AS BIGINT)) OVER g AS DOUBLE) / 10000 / count(*) OVER g AS peer_mean,
               round(quantile_cont(value, 0.5) OVER g, 9) AS peer_median
        FROM peers WINDOW g AS (PARTITION BY industry, year, metric)""",
    ),
)
def peer_rank(spark, sf_dir):
    """Every ratio of every company among the companies of its industry and year."""
    return ratios.peer_rank(layer(spark, sf_dir, "peers", _peers), "value", ["industry", "year", "metric"])


# ---------------------------------------------------------------- market data

SHARES_SQL = """
shares AS (SELECT DISTINCT upper(replace(p_brand, '#', '.')) AS ticker,
                  CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) * 1000 AS shares_outstanding FROM part)
"""


def _shares(spark, sf_dir):
    return (
        table(spark, sf_dir, "part")
        .select(
            F.upper(F.replace("p_brand", F.lit("#"), F.lit("."))).alias("ticker"),
            (F.regexp_extract("p_brand", r"(\d+)$", 1).cast("bigint") * 1000).alias("shares_outstanding"),
        )
        .distinct()
    )


@fundamentals.query(
    "market_scan",
    with_parts(
        BARS_SQL,
        SHARES_SQL,
        body="""SELECT b.ticker, CAST(year(trading_date) AS INT) AS year, max_by(close_price, trading_date) AS year_end_price,
                       max(trading_date) AS priced_on, max(shares_outstanding) AS shares_outstanding,
                       max_by(close_price, trading_date) * max(shares_outstanding) AS market_cap
                FROM bars b JOIN shares s ON s.ticker = b.ticker GROUP BY b.ticker, year(trading_date)""",
    ),
)
def market_scan(spark, sf_dir):
    return st.market_data(stored_bars(spark, sf_dir), _shares(spark, sf_dir))


@fundamentals.query(
    "year_end_price",
    with_parts(
        STATEMENTS_SQL,
        BARS_SQL,
        body="""SELECT s.ticker, s.year, p.close_price AS year_end_price, CAST(p.trading_date AS DATE) AS priced_on,
                       round(p.close_price / nullif(s.net_profit, 0), 8) AS price_to_profit
                FROM (SELECT *, 'BRAND.' || (CAST(substr(ticker, 2) AS BIGINT) % 25 + 1) AS brand,
                             make_date(CAST(year AS BIGINT), 12, 31) + INTERVAL 1 DAY AS year_end FROM statements) s
                ASOF LEFT JOIN (SELECT * FROM bars WHERE NOT (ticker LIKE '%5' AND year(trading_date) % 3 <> 1)) p
                ON p.ticker = s.brand AND s.year_end > p.trading_date""",
    ),
)
def year_end_price(spark, sf_dir):
    """Some tickers have bars in one year of three only: the others take the last price before."""
    gaps = F.col("ticker").endswith("5") & (F.year("trading_date") % 3 != 1)
    prices = st.year_end_prices(stored_bars(spark, sf_dir).filter(~gaps))
    brand = F.concat(F.lit("BRAND."), F.substring("ticker", 2, 20).cast("bigint") % 25 + 1)
    reported = statements(spark, sf_dir).withColumn("brand", brand)
    known = st.prices_as_of(prices, reported.select(F.col("brand").alias("ticker"), "year"))
    joined = reported.join(known.withColumnRenamed("ticker", "brand"), ["brand", "year"], "left")
    return joined.select(
        "ticker",
        "year",
        "year_end_price",
        F.to_date("priced_on").alias("priced_on"),
        F.round(ratios.ratio(F.col("year_end_price"), F.col("net_profit")), 8).alias("price_to_profit"),
    )
