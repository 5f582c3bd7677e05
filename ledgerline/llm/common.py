"""What several operators share: settings, work tables, texts and per-process caches."""

from __future__ import annotations

import re
import sys
from types import SimpleNamespace

from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import configure, stored, work_dir

__all__ = [
    "SPACE", "WORD", "documents", "empty_if_null", "process_cache", "reading", "shared_folder", "stored", "table",
    "work_dir", "writing",
]

# White space and words as the result contracts define them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# Rows per Arrow batch: bounds what a Python worker holds when texts are long.
BATCH_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def empty_if_null(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, as an address for ``writing`` and ``reading``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(work_dir(spark, name))
    system = path.getFileSystem(conf)
    system.mkdirs(path)
    return re.sub(r"^file:/+", "file:///", system.makeQualified(path).toString())


def writing(address: str):
    """A stream for a new file in the shared folder."""
    system, path = FileSystem.from_uri(address)
    return system.open_output_stream(path, compression=None)


def reading(address: str):
    """A file in the shared folder, open for range reads."""
    system, path = FileSystem.from_uri(address)
    return system.open_input_file(path)


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so later tasks find it filled."""
    space = sys.modules.setdefault("_ledgerline_llm_cache", SimpleNamespace())
    if not hasattr(space, name):
        setattr(space, name, {})
    return getattr(space, name)
