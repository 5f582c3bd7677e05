"""Statement items: shapes, names, units, gaps and outliers.

(ticker, period, item) is unique, so a company never has more rows than its periods:
windows per company are bounded by the calendar, not by the size of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.aliases import METRIC_ALIASES, STATEMENT_OF, UNITS
from ledgerline.functions.numeric import clip, finite
from ledgerline.operators.quantiles import exact_quantiles

NOT_NEGATIVE = ["total_assets", "current_assets", "current_liabilities", "inventory", "net_revenue"]

_ITEM = "struct<metric_code:string,metric_name:string,unit:string,category:string,values:map<string,double>>"
REPORT_SCHEMA = (
    "ticker string, period_type string, periods array<string>, "
    + ", ".join(f"{part} array<{_ITEM}>" for part in ["balance_sheet", "income_statement", "cash_flow"])
)
REPORT_PARTS = {"balance_sheet": "BS", "income_statement": "IS", "cash_flow": "CF"}


def to_long(wide: DataFrame, ids: list[str], items: list[str]) -> DataFrame:
    """One row per item. Rows stay in their partition, so a table dealt by company remains so."""
    cells = [F.struct(F.lit(i).alias("metric_code"), F.col(i).alias("value")) for i in items]
    return wide.select(*ids, F.inline(F.array(*cells)))


def to_wide(long: DataFrame, ids: list[str], items: list[str]) -> DataFrame:
    """One column per item; the item list is given, so no pass over the data finds it.

    One aggregate whose partial results hold all items of a row: what a task has of a row is
    sent once, not once per item.
    """
    here = F.col("metric_code")
    return long.groupBy(*ids).agg(*[F.max(F.when(here == i, F.col("value"))).alias(i) for i in items])


def statement_kind(metric: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in STATEMENT_OF.items() for x in pair])
    return F.try_element_at(kinds, metric)


# Rows of one column per item that a task turns into reports.
REPORT_ROWS = 20_000


def by_company(wide: DataFrame, task_rows: int = REPORT_ROWS) -> DataFrame:
    """Rows dealt to tasks by company, so many that a task has few enough to sort in memory.

    Done before items become rows, so items are never shuffled one by one: ``to_long`` and
    ``to_reports`` keep to the partition. ``wide`` is counted first: pass a stored table.
    """
    return wide.repartition(max(1, math.ceil(wide.count() / task_rows)), "ticker")


def to_reports(long: DataFrame, period: str = "period") -> DataFrame:
    """Nested report per company: a period map per item, items by statement.

    An item keeps its reported name and category, null where the items carry none. Names are
    not part of an item's key: of two names for one code the first in text order counts.
    Nothing is shuffled where ``long`` is dealt by company (``by_company``).
    """
    texts = {
        name: F.min(name) if name in long.columns else F.lit(None).cast("string") for name in ["metric_name", "category"]
    }
    items = long.groupBy("ticker", "period_type", "statement", "metric_code", "unit").agg(
        F.array_sort(F.collect_list(F.struct(F.col(period).alias("period"), "value"))).alias("values"),
        *[column.alias(name) for name, column in texts.items()],
    )
    item = F.struct("metric_code", "metric_name", "unit", "category", "values")
    parts = [
        F.array_sort(F.collect_list(F.when(F.col("statement") == kind, item))).alias(f"_{part}")
        for part, kind in REPORT_PARTS.items()
    ]
    periods = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col("values.period")))))
    grouped = items.groupBy("ticker", "period_type").agg(periods.alias("periods"), *parts)

    def as_map(i: Column) -> Column:
        return i.withField("values", F.map_from_entries(i["values"]))

    return grouped.select(
        "ticker", "period_type", "periods", *[F.transform(f"_{part}", as_map).alias(part) for part in REPORT_PARTS]
    )


def is_header(name: str | Column) -> Column:
    """Whether an item's name is that of a header row: written without lower-case letters."""
    text = F.col(name) if isinstance(name, str) else name
    return F.upper(text) == text


def report_items(reports: DataFrame, statement: str, period_type: str) -> DataFrame:
    """Long items of one kind of statement and period."""
    chosen = from_reports(reports.filter(F.col("period_type") == period_type))
    return chosen.filter(F.col("statement") == statement)


def from_reports(reports: DataFrame) -> DataFrame:
    """Long items of nested reports."""
    def tagged(part: str, kind: str) -> Column:
        return F.transform(
            part, lambda i: F.struct(F.lit(kind).alias("statement"), i.alias("item"))
        )

    all_items = F.concat(*[tagged(part, kind) for part, kind in REPORT_PARTS.items()])
    items = reports.select("ticker", "period_type", F.inline(all_items))
    return items.select(
        "ticker",
        "period_type",
        "statement",
        "item.metric_code",
        "item.metric_name",
        "item.unit",
        "item.category",
        F.explode("item.values").alias("period", "value"),
    )


def alias_table(spark, extra: list[tuple[str, str]] = ()) -> DataFrame:
    """Alias to standard key, one key per alias: an added alias replaces the known one."""
    keys: dict[str, str] = {}
    for key, _, aliases in METRIC_ALIASES:
        keys.update({alias.strip().lower(): key for alias in aliases})
    keys.update({alias.strip().lower(): key for alias, key in extra if alias.strip()})
    return spark.createDataFrame(sorted(keys.items()), "alias string, standard_key string")


def map_metrics(items: DataFrame, aliases: DataFrame, name: str = "metric_name") -> DataFrame:
    """Add the standard key of each reported name; unknown names keep a null key.

    The alias table has a few dozen rows that do not grow with the data: broadcast.
    """
    keyed = items.withColumn("alias", F.lower(F.trim(name)))
    return keyed.join(F.broadcast(aliases), "alias", "left").drop("alias")


def convert_units(items: DataFrame, target: str = "BILLION_VND") -> DataFrame:
    """Values to the target unit; an unknown unit yields null, not a wrong number."""
    factors = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    factor = F.try_element_at(factors, F.col("unit"))
    return items.withColumn("value", F.col("value") * factor / UNITS[target]).withColumn(
        "unit", F.when(factor.isNotNull(), F.lit(target))
    )


def negative_flags(wide: DataFrame, items: list[str] = NOT_NEGATIVE) -> DataFrame:
    """Items that should never be below zero but are."""
    flags = [F.when(F.col(i) < 0, F.lit(i)) for i in items]
    return wide.withColumn("negative_items", F.array_compact(F.array(*flags)))


def drop_sparse(wide: DataFrame, items: list[str], most_missing: float = 0.5) -> DataFrame:
    """Drop rows with too many missing items; never interpolate.

    The number comes out of an array of one, through which no filter is pushed: pushed down, it
    would hold the expressions of all items and work them out again.
    """
    missing = sum((F.col(i).isNull().cast("int") for i in items), F.lit(0))
    return wide.select("*", F.explode(F.array(missing)).alias("missing_items")).filter(
        F.col("missing_items") <= most_missing * len(items)
    )


def missing_report(wide: DataFrame, items: list[str]) -> DataFrame:
    """Missing values per item and overall, counted in one pass."""
    counts = wide.agg(
        F.count("*").alias("_rows"), *[F.sum(F.col(i).isNull().cast("long")).alias(i) for i in items]
    )
    total = sum((F.col(i) for i in items), F.lit(0))
    long = counts.withColumn("ALL", total).unpivot(["_rows"], [*items, "ALL"], "metric_code", "missing_count")
    cells = F.when(F.col("metric_code") == "ALL", F.col("_rows") * len(items)).otherwise(F.col("_rows"))
    pct = F.round(F.try_divide(F.col("missing_count") * 100.0, cells), 4)
    severity = F.when(pct == 0, "none").when(pct <= 5, "low").otherwise("high")
    return long.select("metric_code", "missing_count", pct.alias("missing_pct"), severity.alias("severity"))


def longest_run(statements: DataFrame) -> DataFrame:
    """Longest run of consecutive years per company."""
    years = statements.select("ticker", "year").distinct()
    order = Window.partitionBy("ticker").orderBy("year")
    islands = years.withColumn("_island", F.col("year") - F.row_number().over(order))
    runs = islands.groupBy("ticker", "_island").agg(F.count("*").alias("_run"))
    return runs.groupBy("ticker").agg(F.max("_run").alias("longest_run"))


def min_history(statements: DataFrame, years: int = 5) -> DataFrame:
    """Rows of the companies with at least so many consecutive years."""
    kept = longest_run(statements).filter(F.col("longest_run") >= years).select("ticker")
    return statements.join(kept, "ticker", "left_semi")


def qualification(statements: DataFrame, years: int = 5) -> DataFrame:
    """Companies in total, qualified and rejected by the history rule."""
    enough = F.col("longest_run") >= years
    return longest_run(statements).agg(
        F.count("*").alias("total_companies"),
        F.count_if(enough).alias("qualified_companies"),
        F.count_if(~enough).alias("rejected_companies"),
    )


def winsor_bounds(wide: DataFrame, metrics: list[str], percent: int = 1) -> dict[str, tuple]:
    """Lower and upper percentile per metric: two numbers for each listed metric."""
    if percent == 0:
        return {}
    low, high = percent / 100, 1 - percent / 100
    long = wide.select([finite(F.col(m)).alias(m) for m in metrics]).unpivot(
        [], metrics, "metric", "value"
    )
    rows = exact_quantiles(long, ["metric"], "value", [low, high]).collect()
    found = {(r["metric"], r["p"]): r["quantile"] for r in rows}
    return {m: (found[m, low], found[m, high]) for m in metrics if (m, low) in found}


def winsorize(wide: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Clip metrics to their bounds; infinite values become null."""
    return wide.withColumns(
        {m: clip(finite(F.col(m)), F.lit(lo), F.lit(hi)) for m, (lo, hi) in bounds.items()}
    )


def outlier_log(wide: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Cells that winsorizing changes, with what happens to them."""
    long = wide.unpivot(["ticker", "year"], list(bounds), "metric", "raw_value")
    limits = F.create_map(
        *[x for m, (lo, hi) in bounds.items() for x in (F.lit(m), F.array(F.lit(lo), F.lit(hi)))]
    )
    pair = F.element_at(limits, F.col("metric"))
    action = (
        F.when(finite(F.col("raw_value")).isNull(), "SET_NULL")
        .when(F.col("raw_value") < pair[0], "RAISED_TO_LOW")
        .when(F.col("raw_value") > pair[1], "CUT_TO_HIGH")
    )
    treated = clip(finite(F.col("raw_value")), pair[0], pair[1])
    return (
        long.filter(F.col("raw_value").isNotNull())
        .select("ticker", "metric", "year", "raw_value", treated.alias("treated_value"), action.alias("action"))
        .filter(F.col("action").isNotNull())
    )


def year_end_prices(bars: DataFrame) -> DataFrame:
    """Last close of each ticker-year; partial maxima, so long series shrink first."""
    return bars.groupBy("ticker", F.year("trading_date").cast("int").alias("year")).agg(
        F.max_by("close_price", "trading_date").alias("year_end_price"),
        F.max("trading_date").alias("priced_on"),
    )


def prices_as_of(prices: DataFrame, wanted: DataFrame) -> DataFrame:
    """The last price at or before the end of each wanted ticker-year.

    ``prices`` are the last closes per ticker-year that has bars. Both sides become one series
    per ticker and the last price is carried over years without one. A series has a row per
    year, so its window is as long as the calendar, however many bars or askers there are.
    """
    asked = wanted.select("ticker", F.col("year").cast("int").alias("year")).distinct()
    marks = prices.withColumn("_asked", F.lit(0)).unionByName(
        asked.withColumn("_asked", F.lit(1)), allowMissingColumns=True
    )
    years = marks.groupBy("ticker", "year").agg(
        F.max(F.when(F.col("_asked") == 0, F.struct("year_end_price", "priced_on"))).alias("_price"),
        F.max("_asked").alias("_asked"),
    )
    carried = F.last("_price", ignorenulls=True).over(
        Window.partitionBy("ticker").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    )
    last = years.withColumn("_last", carried).filter(F.col("_asked") == 1)
    return last.select("ticker", "year", "_last.year_end_price", "_last.priced_on")


def market_data(bars: DataFrame, shares: DataFrame) -> DataFrame:
    """Year-end price and market capitalisation; ``shares`` has one row per ticker."""
    return year_end_prices(bars).join(shares, "ticker").withColumn(
        "market_cap", F.col("year_end_price") * F.col("shares_outstanding")
    )
