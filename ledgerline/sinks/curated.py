"""Write the curated layer: Parquet partitioned by ticker, and how many rows lie in which month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A folder that readers of the layer pass over, as all that begin with an underscore.
POSITIONS = "_positions"
POSITION_SCHEMA = "month date, rows bigint, ticker string"


def _mode(replace_all: bool) -> str:
    return "static" if replace_all else "dynamic"


def write_curated(curated: DataFrame, root: str, replace_all: bool = False, dates: DataFrame | None = None) -> None:
    """Replace the partitions of the tickers present; other tickers stay as they are.

    The rebalance brings a ticker's rows together for writing but splits a ticker that is
    larger than the advisory partition size over several files instead of one task.

    ``dates`` has ticker and trading_date of the same rows, from a stored table: then the rows
    per ticker and month are kept beside the layer, so that pages can be found by their month.
    Without it positions known before are dropped, as they no longer hold.
    """
    (
        curated.hint("rebalance", F.col("ticker"))
        .sortWithinPartitions("ticker", "trading_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", _mode(replace_all))
        .partitionBy("ticker")
        .parquet(root)
    )
    if dates is None:
        drop_positions(curated.sparkSession, root)
        return
    months = dates.groupBy("ticker", F.trunc(F.to_date("trading_date"), "month").alias("month"))
    (
        months.agg(F.count("*").alias("rows"))
        .repartition("ticker")
        .sortWithinPartitions("ticker", "month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", _mode(replace_all))
        .partitionBy("ticker")
        .parquet(f"{root}/{POSITIONS}")
    )


def drop_positions(spark: SparkSession, root: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{POSITIONS}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_positions(spark: SparkSession, root: str) -> DataFrame | None:
    """Rows per ticker and month, where the layer was written with them."""
    folder = f"{root}/{POSITIONS}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(POSITION_SCHEMA).parquet(folder)
