"""The final dataset: one row per company and year, ready for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numeric import ratio

DATASET_COLUMNS = [
    "ticker",
    "company_name",
    "year",
    "exchange",
    "industry",
    "roa",
    "roe",
    "current_ratio",
    "debt_to_ta",
    "ebit_margin",
    "log_total_assets",
    "z_score",
    "distress_label",
]
FEATURES = DATASET_COLUMNS[5:12]


def assemble(ratios: DataFrame, labels: DataFrame, companies: DataFrame) -> DataFrame:
    """Ratios, labels and company facts joined on (ticker, year)."""
    judged = labels.select("ticker", "year", F.round("z_score", 4).alias("z_score"), "distress_label")
    facts = companies.select("ticker", F.col("name").alias("company_name"), "exchange", "industry")
    return ratios.join(judged, ["ticker", "year"]).join(facts, "ticker", "left").select(*DATASET_COLUMNS)


def summary(dataset: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Size, year range, label balance and missing share in one aggregate."""
    missing = sum((F.col(f).isNull().cast("int") for f in features), F.lit(0))
    return dataset.agg(
        F.count("*").alias("total_rows"),
        F.count_distinct("ticker").alias("total_companies"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.count_if(F.col("distress_label") == 0).alias("label_0_count"),
        F.count_if(F.col("distress_label") == 1).alias("label_1_count"),
        F.sum(missing).alias("_missing"),
    ).select(
        "total_rows",
        "total_companies",
        "first_year",
        "last_year",
        "label_0_count",
        "label_1_count",
        F.round(ratio(F.col("label_1_count") * 100.0, F.col("total_rows").cast("double")), 4).alias("distress_ratio_pct"),
        F.round(ratio(F.col("label_0_count").cast("double"), F.col("label_1_count").cast("double")), 4).alias("imbalance_ratio"),
        F.round(F.col("_missing") * 100.0 / (F.col("total_rows") * len(features)), 4).alias("missing_rate_overall"),
    )


def time_split(
    dataset: DataFrame, train: tuple[int, int], test: tuple[int, int]
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by year, never at random."""
    if train[1] >= test[0]:
        raise ValueError("test years must follow the training years")
    year = F.col("year")
    return dataset.filter(year.between(*train)), dataset.filter(year.between(*test))


def class_weight(dataset: DataFrame, label: str = "distress_label") -> DataFrame:
    """Add ``weight`` = rows / (2 * rows of the class); a binary label has two counts."""
    counts = dataset.groupBy(label).agg(F.count("*").alias("_n"))
    total = Window.partitionBy(F.lit(1))
    weights = counts.select(label, (F.sum("_n").over(total) / (2 * F.col("_n"))).alias("weight"))
    return dataset.join(F.broadcast(weights), label)


def risk_level(probability_pct: Column) -> Column:
    return (
        F.when(probability_pct < 10, "LOW").when(probability_pct <= 50, "MODERATE").otherwise("HIGH")
    )


def risk_trend(scores: DataFrame) -> DataFrame:
    """Probability per year with its change, and the company's series so far.

    A company has one score per year, so its window is as long as the calendar.
    """
    order = Window.partitionBy("ticker").orderBy("year")
    history = order.rowsBetween(Window.unboundedPreceding, 0)
    change = F.col("probability_pct") - F.lag("probability_pct").over(order)
    return scores.withColumns(
        {
            "change": F.round(change, 4),
            "direction": F.when(change < 0, "down").when(change > 0, "up").when(change == 0, "flat"),
            "history": F.collect_list(F.struct("year", "probability_pct")).over(history),
        }
    )


def risk_screen(scores: DataFrame, level: str = "HIGH", top: int | None = None) -> DataFrame:
    """Companies at a risk level, riskiest first."""
    hits = scores.filter(F.col("risk_level") == level).orderBy(
        F.col("probability_pct").desc(), "ticker", "year"
    )
    return hits.limit(top) if top else hits
