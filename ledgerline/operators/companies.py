"""Company master data: listing, enrichment, filters, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import is_financial, market_name, or_else
from ledgerline.operators.dedup import first_rows, keep_first

# Companies taken per market.
QUOTAS = {"HOSE": 70, "HNX": 20, "UPCOM": 10}

MASTER_COLUMNS = ["ticker", "name", "market", "sector"]
_SOURCE_NAMES = {"symbol": "ticker", "organ_name": "name", "exchange": "market"}

# Labels of the two company groups.
FINANCIAL_SECTOR = "Tài chính"
OTHER_SECTOR = "Phi tài chính"


def backfill_schema(companies: DataFrame) -> DataFrame:
    """Provider names to canonical ones; required columns that are absent become empty text."""
    renamed = companies.withColumnsRenamed(_SOURCE_NAMES)
    absent = [c for c in MASTER_COLUMNS if c not in renamed.columns]
    return renamed.withColumns({c: F.lit("") for c in absent}) if absent else renamed


def normalize_market(companies: DataFrame, column: str = "market") -> DataFrame:
    return companies.withColumn(column, market_name(F.col(column)))


def market_quota(companies: DataFrame, order: str, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """The first companies of each market in list order.

    The highest quota is a constant rank limit, which Spark applies on the map side; the
    quota of the market then trims what is left.
    """
    ranked = first_rows(
        companies.filter(F.col("market").isin(list(quotas))),
        ["market"],
        F.col(order),
        max(quotas.values()),
        "market_rank",
    )
    quota = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    return ranked.filter(F.col("market_rank") <= F.element_at(quota, F.col("market")))


def listing(exchange_list: DataFrame, symbols: DataFrame, order: str) -> DataFrame:
    """Exchange list with symbol names, one row per ticker (the first listed)."""
    listed = keep_first(exchange_list, ["ticker"], order)
    names = keep_first(symbols, ["ticker"], "position")
    return listed.join(names, "ticker", "left")


# Texts of a company overview, beside its name, sector, listing flag and listing date.
OVERVIEW_TEXTS = ["short_name", "company_profile", "com_type_code", "com_group_code", "tag", "icb_code_lv2"]


def enrich(listed: DataFrame, overview: DataFrame, source: str, updated_on: str | Column) -> DataFrame:
    """Add overview facts; an empty overview name gives way to the listed one.

    Facts that the overview does not carry, and all of them for a ticker without one, are null.
    ``listing`` may come as a boolean or as text or number that says so; anything else is null.
    ``updated_on`` is the day of the run, so that a rerun for a day gives the same rows.
    """
    def fact(name: str) -> Column:
        return F.col(name) if name in overview.columns else F.lit(None).cast("string")

    facts = overview.select(
        "ticker",
        F.col("name").alias("_overview_name"),
        fact("sector").alias("sector"),
        F.try_to_timestamp(fact("listing_date").cast("string")).alias("_listed_on"),
        fact("listing").cast("string").try_cast("boolean").alias("listing"),
        *[fact(c).cast("string").alias(c) for c in OVERVIEW_TEXTS],
    )
    joined = listed.drop("sector", "listing", *OVERVIEW_TEXTS).join(facts, "ticker", "left")
    day = F.lit(updated_on) if isinstance(updated_on, str) else updated_on
    return joined.select(
        *[or_else(F.col("_overview_name"), F.col("name")).alias(c) if c == "name" else F.col(c) for c in listed.columns
          if c not in {"sector", "listing", *OVERVIEW_TEXTS}],
        "sector",
        "listing",
        F.date_format("_listed_on", "yyyy-MM-dd").alias("listing_date"),
        *OVERVIEW_TEXTS,
        F.lit(source).alias("source"),
        day.alias("updated_at"),
    )


def classify(companies: DataFrame, given: str | None = None) -> DataFrame:
    """Add whether a company is financial, its sector group and its listing status."""
    flag = is_financial(F.col("industry"), F.col(given) if given else None)
    status = F.col("status") if "status" in companies.columns else F.lit(None).cast("string")
    return companies.withColumn("is_financial", flag).withColumns(
        {
            "sector": F.when(F.col("is_financial"), FINANCIAL_SECTOR).otherwise(OTHER_SECTOR),
            "status": F.coalesce(status, F.lit("LISTED")),
        }
    )


def search(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring in any of the columns; an empty term matches all."""
    if not term:
        return df
    hits = [F.lower(c).contains(term.lower()) for c in columns]
    return df.filter(reduce(lambda a, b: a | b, hits))


def facets(df: DataFrame, **chosen: str) -> DataFrame:
    """Equality per facet; "ALL" leaves a facet open."""
    for column, value in chosen.items():
        if value != "ALL":
            df = df.filter(F.col(column) == value)
    return df


def exclude_financial(classified: DataFrame, exclude: bool = True) -> DataFrame:
    return classified.filter(~F.col("is_financial")) if exclude else classified


def company_counts(classified: DataFrame, shown: DataFrame) -> DataFrame:
    """Total, financial and shown companies."""
    totals = classified.agg(
        F.count("*").alias("total"), F.count_if("is_financial").alias("financial")
    )
    parts = totals.unionByName(shown.agg(F.count("*").alias("filtered")), allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in ["total", "financial", "filtered"]])


def market_counts(companies: DataFrame) -> DataFrame:
    """Companies per market and in total."""
    return (
        companies.rollup("market")
        .agg(F.count("*").alias("companies"))
        .select(F.coalesce("market", F.lit("TOTAL")).alias("market"), "companies")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values without nulls and empty text."""
    return df.select(column).filter(F.col(column) != "").distinct().orderBy(column)
