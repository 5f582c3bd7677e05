"""Tables that grow by micro-batches: a part per batch, merged level by level.

A part is a folder named after the first and last batch it holds. A batch writes its own
part and nothing else, so writing it again replaces it. Before a batch starts, ``FAN_IN``
finished parts of one size are merged into one of the next size, of rows with one key the
last batch's; what they replace is removed. So the number of parts grows with the logarithm
of the batches, every row is written again once per level, and rows that were overtaken go.

A part counts once its commit marker is there. A merge that breaks off leaves the parts it
was made of, and is made again: parts inside a finished larger one are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.dedup import keep_last

FAN_IN = 8
BATCH = "batch_id"


@dataclass(frozen=True)
class Versioned:
    """Where a table lies, its columns, its key, and which stored rows are part of it."""

    root: str
    schema: str
    keys: tuple[str, ...]
    rows: str = "true"

    @property
    def stored_schema(self) -> str:
        return f"{self.schema}, {BATCH} bigint"


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _folder(table: Versioned, first: int, last: int) -> str:
    return f"{table.root}/{first:010d}-{last:010d}"


def parts(spark: SparkSession, table: Versioned, before: int | None = None) -> list[tuple[int, int]]:
    """First and last batch of the parts that count, in order."""
    place, system = _system(spark, table.root)
    if not system.exists(place):
        return []
    names = [f.getPath().getName() for f in system.listStatus(place) if f.isDirectory()]
    found = sorted(tuple(map(int, n.split("-"))) for n in names if len(n) == 21)
    done = [p for p in found if system.exists(_system(spark, f"{_folder(table, *p)}/_SUCCESS")[0])]
    done = [p for p in done if before is None or p[1] < before]
    return [p for p in done if not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in done)]


def add(table: Versioned, rows: DataFrame, batch: int) -> None:
    """Store what a batch changes; a replay replaces it."""
    rows.withColumn(BATCH, F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(_folder(table, batch, batch))


def part(spark: SparkSession, table: Versioned, batch: int) -> DataFrame:
    """What one batch has stored."""
    return spark.read.schema(table.stored_schema).parquet(_folder(table, batch, batch)).drop(BATCH)


def _read(spark: SparkSession, table: Versioned, chosen: list[tuple[int, int]]) -> DataFrame:
    if not chosen:
        return spark.createDataFrame([], table.stored_schema).filter(table.rows)
    folders = [_folder(table, *p) for p in chosen]
    return spark.read.schema(table.stored_schema).parquet(*folders).filter(table.rows)


def every_version(spark: SparkSession, table: Versioned, before: int | None = None) -> DataFrame:
    """The rows of all parts with their batch, overtaken ones that are still stored included."""
    return _read(spark, table, parts(spark, table, before))


def newest(spark: SparkSession, table: Versioned, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """The table after all batches so far, or before one. ``only`` keeps the keys that it names.

    A single part holds each key once and is read as it is.
    """
    chosen = parts(spark, table, before)
    rows = _read(spark, table, chosen)
    if only is not None:
        rows = rows.join(only, only.columns, "left_semi")
    return rows.drop(BATCH) if len(chosen) < 2 else keep_last(rows, list(table.keys), BATCH)


def compact(spark: SparkSession, table: Versioned, before: int) -> None:
    """Merge the newest parts of one size, as long as there are ``FAN_IN`` of them.

    Called at the start of a batch: what came before is committed and will not be replayed.
    """
    while True:
        done = parts(spark, table, before)
        tail = done[-FAN_IN:]
        sizes = {last - first for first, last in tail}
        if len(tail) < FAN_IN or len(sizes) > 1:
            break
        keys = list(table.keys)
        versions = _read(spark, table, tail)
        values = [c for c in versions.columns if c not in keys]
        # The batch stays with the row: parts beside this one may hold newer rows.
        kept = versions.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_row")).select(*keys, "_row.*")
        merged = kept.select(*versions.columns).repartitionByRange(*keys).sortWithinPartitions(*keys)
        merged.write.mode("overwrite").parquet(_folder(table, tail[0][0], tail[-1][1]))
        for old in tail:
            place, system = _system(spark, _folder(table, *old))
            system.delete(place, True)
