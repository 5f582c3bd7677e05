"""CSV reports, price exports and dataset exports."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "\uFEFF"


def write_report(report: DataFrame, path: str, sep: str = ",", bom: bool = True) -> None:
    """CSV with a header; the byte-order mark lets spreadsheets detect UTF-8."""
    first = report.columns[0]
    named = report.withColumnRenamed(first, BOM + first) if bom else report
    named.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


class Export(NamedTuple):
    rows: DataFrame
    manifest: DataFrame


def price_export(curated: DataFrame, ticker: str, form: str = "csv") -> Export:
    """All rows of one ticker by date, and a manifest with their number.

    No rows mean no manifest either, so an unknown ticker is an empty export.
    """
    symbol = ticker.strip().upper()
    rows = curated.filter(F.col("ticker") == symbol).orderBy("trading_date")
    manifest = (
        rows.groupBy("ticker")
        .agg(F.count("*").alias("row_count"))
        .select(
            F.lit("curated parquet").alias("source"),
            "ticker",
            F.current_timestamp().alias("export_time"),
            F.lit(form).alias("format"),
            "row_count",
            F.array(*[F.lit(c) for c in curated.columns]).alias("columns"),
            F.lit("1.0").alias("schema_version"),
        )
    )
    return Export(rows, manifest)


def write_export(export: Export, path: str, form: str = "csv") -> None:
    """Write the rows as CSV or Parquet and the manifest as JSON next to them."""
    if form not in ("csv", "parquet"):
        raise ValueError(f"unknown export format {form!r}")
    writer = export.rows.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(f"{path}/data")
    else:
        writer.parquet(f"{path}/data")
    export.manifest.write.mode("overwrite").json(f"{path}/manifest")


# Headings of the exported dataset.
DATASET_HEADINGS = {
    "ticker": "Ticker",
    "company_name": "Tên công ty",
    "year": "Năm",
    "exchange": "Sàn",
    "industry": "Ngành nghề",
    "roa": "ROA (%)",
    "roe": "ROE (%)",
    "current_ratio": "Current Ratio",
    "debt_to_ta": "Debt Ratio",
    "ebit_margin": "EBIT Margin (%)",
    "log_total_assets": "Log Assets",
    "z_score": "Z-Score",
    "distress_label": "Distress Label",
}


def write_dataset(dataset: DataFrame, path: str, form: str) -> None:
    """Final dataset as CSV, tab-separated text, or Parquet marking the target column."""
    columns = list(DATASET_HEADINGS)
    if form == "parquet":
        marked = [
            F.col(c).alias(c, metadata={"role": "target"} if c == "distress_label" else {})
            for c in columns
        ]
        dataset.select(*marked).write.mode("overwrite").parquet(path)
        return
    separators = {"csv": ",", "excel": "\t"}
    titled = dataset.select(*[F.col(c).alias(title) for c, title in DATASET_HEADINGS.items()])
    write_report(titled, path, separators[form])
