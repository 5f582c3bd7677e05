"""Accounting ratios, Altman Z-scores and growth, from one row per company and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numeric import ratio
from ledgerline.operators.quantiles import value_ranks
from ledgerline.session import stored

LIQUIDITY = ["current_ratio", "working_capital_to_ta", "ocf_to_current_liabilities"]
PROFITABILITY = ["roa", "roe", "ebit_margin", "ebit_to_ta", "asset_turnover"]
LEVERAGE = ["short_term_debt_to_ta", "long_term_debt_to_ta", "debt_to_ta"]
SIZE_GROWTH = [
    "log_total_assets",
    "asset_growth",
    "profit_growth",
    "market_cap",
    "market_equity_to_debt",
]
RATIOS = LIQUIDITY + PROFITABILITY + LEVERAGE + SIZE_GROWTH

# Altman's weights and zone limits.
Z_WEIGHTS = (1.2, 1.4, 3.3, 0.6, 0.999)
Z_SAFE, Z_DISTRESS = 2.99, 1.81
EMERGING_CONSTANT, EMERGING_WEIGHTS = 3.25, (6.56, 3.26, 6.72, 1.05)
EMERGING_SAFE, EMERGING_DISTRESS = 5.85, 4.15


def previous_year(column: str) -> Column:
    """Last year's value; null when the year before is missing."""
    order = Window.partitionBy("ticker").orderBy("year")
    return F.when(F.lag("year").over(order) == F.col("year") - 1, F.lag(column).over(order))


def previous_quarter(column: str, step: int = 1) -> Column:
    """Value of the quarter before (``step`` -1: after); null when that quarter is missing."""
    index = F.col("year") * 4 + F.col("quarter")
    order = Window.partitionBy("ticker").orderBy("year", "quarter")
    return F.when(
        F.lag(index, step).over(order) == index - step, F.lag(column, step).over(order)
    )


def growth(current: Column, previous: Column) -> Column:
    """Change in percent of the previous size."""
    return ratio(current - previous, F.abs(previous), 100.0)


def liquidity() -> dict[str, Column]:
    ca, cl, ta = F.col("current_assets"), F.col("current_liabilities"), F.col("total_assets")
    return {
        "current_ratio": ratio(ca, cl),
        "working_capital_to_ta": ratio(ca - cl, ta),
        "ocf_to_current_liabilities": ratio(F.col("operating_cash_flow"), cl),
    }


def profitability() -> dict[str, Column]:
    ta, revenue, ebit = F.col("total_assets"), F.col("net_revenue"), F.col("ebit")
    profit = F.col("net_profit")
    return {
        "roa": ratio(profit, ta, 100.0),
        "roe": ratio(profit, F.col("equity"), 100.0),
        "ebit_margin": ratio(ebit, revenue, 100.0),
        "ebit_to_ta": ratio(ebit, ta, 100.0),
        "asset_turnover": ratio(revenue, ta),
    }


def leverage() -> dict[str, Column]:
    ta = F.col("total_assets")
    return {
        "short_term_debt_to_ta": ratio(F.col("current_liabilities"), ta),
        "long_term_debt_to_ta": ratio(F.col("long_term_debt"), ta),
        "debt_to_ta": ratio(F.col("total_liabilities"), ta),
    }


def size_growth() -> dict[str, Column]:
    ta, profit = F.col("total_assets"), F.col("net_profit")
    previous_assets = previous_year("total_assets")
    return {
        "log_total_assets": F.when(ta > 0, F.log10(ta)),
        "asset_growth": ratio(ta - previous_assets, previous_assets, 100.0),
        "profit_growth": growth(profit, previous_year("net_profit")),
        "market_cap": F.col("market_cap"),
        "market_equity_to_debt": ratio(F.col("market_cap"), F.col("total_liabilities")),
    }


def ratios(statements: DataFrame, digits: int = 4) -> DataFrame:
    """All sixteen accounting ratios; one shuffle by company for the growth columns."""
    columns = {**liquidity(), **profitability(), **leverage(), **size_growth()}
    return statements.select(
        "ticker", "year", *[F.round(e, digits).alias(n) for n, e in columns.items()]
    )


def z_components(statements: DataFrame) -> DataFrame:
    """Add the five Altman components."""
    ta = F.col("total_assets")
    return statements.withColumns(
        {
            "x1": ratio(F.col("current_assets") - F.col("current_liabilities"), ta),
            "x2": ratio(F.col("retained_earnings"), ta),
            "x3": ratio(F.col("ebit"), ta),
            "x4": ratio(F.col("market_cap"), F.col("total_liabilities")),
            "x5": ratio(F.col("net_revenue"), ta),
        }
    )


def z_score() -> Column:
    """Z from the components, added from left to right."""
    terms = [F.lit(w) * F.col(f"x{i}") for i, w in enumerate(Z_WEIGHTS, 1)]
    return sum(terms[1:], terms[0])


def emerging_z_score() -> Column:
    a, b, c, d = EMERGING_WEIGHTS
    equity = ratio(F.col("equity"), F.col("total_liabilities"))
    return (
        F.lit(EMERGING_CONSTANT)
        + F.lit(a) * F.col("x1")
        + F.lit(b) * F.col("x2")
        + F.lit(c) * F.col("x3")
        + F.lit(d) * equity
    )


def zone(z: Column, safe: float = Z_SAFE, distress: float = Z_DISTRESS) -> Column:
    return F.when(z > safe, "SAFE").when(z < distress, "DISTRESS").when(z.isNotNull(), "GREY")


def zone_risk(zone_name: Column) -> Column:
    return (
        F.when(zone_name == "SAFE", "low")
        .when(zone_name == "GREY", "medium")
        .when(zone_name == "DISTRESS", "high")
    )


def altman(statements: DataFrame, safe: float = Z_SAFE, distress: float = Z_DISTRESS) -> DataFrame:
    """Components, score and zone per company and year."""
    scored = z_components(statements).withColumn("z_score", z_score())
    return scored.withColumn("zone", zone(F.col("z_score"), safe, distress))


def z_variants(statements: DataFrame) -> DataFrame:
    """Rows per zone and unit-wide score bin, for the original and the emerging-market score."""
    scored = z_components(statements)
    variants = F.array(
        F.struct(F.lit("original").alias("variant"), z_score().alias("z"), zone(z_score()).alias("zone")),
        F.struct(
            F.lit("emerging").alias("variant"),
            emerging_z_score().alias("z"),
            zone(emerging_z_score(), EMERGING_SAFE, EMERGING_DISTRESS).alias("zone"),
        ),
    )
    return (
        scored.select(F.inline(variants))
        .groupBy("variant", "zone", F.floor("z").cast("bigint").alias("z_bin"))
        .agg(F.count("*").alias("rows"))
    )


def scenarios(statements: DataFrame, shocks: dict[str, dict[str, float]]) -> DataFrame:
    """Z-score of every row under each shock, e.g. ``{"debt_x2": {"total_liabilities": 2.0}}``.

    The shocks are a short literal list exploded per row, not a join.
    """
    items = sorted({item for factors in shocks.values() for item in factors})
    cases = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                *[F.lit(float(factors.get(i, 1.0))).alias(f"_f_{i}") for i in items],
            )
            for name, factors in shocks.items()
        ]
    )
    shocked = statements.select("*", F.inline(cases)).withColumns(
        {i: F.col(i) * F.col(f"_f_{i}") for i in items}
    )
    return altman(shocked).select("ticker", "year", "scenario", "z_score", "zone")


def loss_features(quarters: DataFrame) -> DataFrame:
    """Inputs of the loss model per company and quarter."""
    revenue = F.col("net_revenue")
    return quarters.select(
        "ticker",
        "year",
        "quarter",
        F.round(ratio(F.col("total_liabilities"), F.col("total_assets")), 4).alias("debt_to_assets"),
        F.round(ratio(revenue - F.col("cogs"), revenue, 100.0), 4).alias("gross_margin"),
        F.round(growth(revenue, previous_quarter("net_revenue")), 4).alias("revenue_growth"),
        F.round(ratio(F.col("current_assets") - F.col("inventory"), F.col("current_liabilities")), 4).alias("quick_ratio"),
    )


def loss_next_period(quarters: DataFrame) -> DataFrame:
    """1 when the following quarter ends in a loss, null when it is not reported."""
    following = previous_quarter("net_profit", -1)
    return quarters.select(
        "ticker",
        "year",
        "quarter",
        F.when(following.isNotNull(), (following < 0).cast("int")).alias("is_loss"),
    )


LOSS_FEATURES = ["debt_to_assets", "gross_margin", "revenue_growth", "quick_ratio"]


def loss_dataset(quarters: DataFrame) -> DataFrame:
    """Features of a quarter with the outcome of the next, where that one is reported."""
    outcome = loss_next_period(quarters).filter(F.col("is_loss").isNotNull())
    return loss_features(quarters).join(outcome, ["ticker", "year", "quarter"])


def business_results(rows: DataFrame, quarterly: bool = False) -> DataFrame:
    """Revenue, profit and profit growth per period."""
    period = (
        F.concat(F.lit("Q"), F.col("quarter"), F.lit("/"), F.col("year"))
        if quarterly
        else F.col("year").cast("string")
    )
    before = previous_quarter("net_profit") if quarterly else previous_year("net_profit")
    return rows.select(
        "ticker",
        period.alias("period"),
        F.col("net_revenue").alias("revenue"),
        F.col("net_profit").alias("profit"),
        F.round(growth(F.col("net_profit"), before), 4).alias("growth"),
    )


def peer_rank(rows: DataFrame, metric: str, group: list[str], decimals: int = 4) -> DataFrame:
    """Position of each row among its peers: percent rank, peer mean and peer median.

    Ratios carry four decimals (``decimals``): for the mean they are added as whole numbers, so
    it does not depend on the order in which rows arrive.

    An industry may hold a third of all companies, so nothing is sorted per industry:
    ranks and medians come from pre-aggregated distinct values, cut into ranges. ``rows`` is
    read several times: pass a stored table.

    Rows meet their ranks by value first, then group: the sort of the join compares numbers and
    seldom gets to the texts that name a group. What is known per group is stored, so its size
    is known when it is joined: small, it is broadcast, and rows are not shuffled by group.
    """
    spark = rows.sparkSession
    ranks = stored(spark, value_ranks(rows.select(*group, metric), group, metric), "peer-ranks")
    stats = rows.groupBy(*group).agg(
        F.count(metric).alias("peers"), (F.sum(F.round(F.col(metric) * 10**decimals).cast("long")) / F.lit(10**decimals) / F.count(metric)).alias("peer_mean")
    )
    placed = ranks.join(stored(spark, stats, "peer-stats"), group)
    middle = (F.col("peers") - 1) / 2

    def value_at(rank: Column) -> Column:
        here = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n_here"))
        return F.max(F.when(here, F.col(metric)))

    low, high = value_at(F.floor(middle)), value_at(F.ceil(middle))
    medians = placed.groupBy(*group).agg(
        (low + (high - low) * 0.5).alias("_between"), low.alias("_low"), F.first("peers").alias("peers"), F.first("peer_mean").alias("peer_mean")
    )
    exact = F.when(F.col("peers") % 2 == 1, F.col("_low")).otherwise(F.col("_between"))
    facts = stored(spark, medians.select(*group, "peers", "peer_mean", exact.alias("peer_median")), "peer-facts")
    percent = F.when(F.col("peers") > 1, F.col("n_before") / (F.col("peers") - 1)).otherwise(0.0)
    return (
        rows.join(ranks, [metric, *group])
        .join(facts, group)
        .select(
            "ticker",
            *group,
            metric,
            "peers",
            F.round(percent, 6).alias("percent_rank"),
            "peer_mean",
            F.round("peer_median", 9).alias("peer_median"),
        )
    )
