"""Exact duplicates: a heavy-hitter split.

A Misra-Gries pass finds the digests that may be frequent. Their counts and winners are
verified by an aggregate with partial results and broadcast, so copies of frequent texts are
settled on the map side; the digests that are left go through an ordinary shuffle, where no
group is larger than the support times all rows.

Texts are equal when they are identical after every run of white space is replaced by one
space. Null counts as empty. Of equal texts the row with the smallest id stays; a null id
comes after all others, and of rows that repeat an id one stays. An empty table gives an
empty result. Only the id and text columns are read for marking, so other columns may have
any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import SPACE, documents, empty_if_null, stored

# Digests above this share of all rows are settled on the map side. At most its reciprocal of
# digests comes back from the Misra-Gries pass, which bounds what is broadcast to some 100 kB.
SUPPORT = 0.001


def digest(text: str | Column) -> Column:
    return F.sha2(F.regexp_replace(empty_if_null(text), SPACE, " "), 256)


def frequent(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Winner and size of each group that may be frequent: at most 1/support rows.

    ``digests`` has doc_id, row_no and text_sha256. The counter summary may name rare digests
    as well, which does no harm: every figure is counted afresh.
    """
    keyed = digests.withColumn("key", F.xxhash64("text_sha256"))
    candidates = keyed.stat.freqItems(["key"], support).select(F.explode("key_freqItems").alias("key"))
    return (
        keyed.join(F.broadcast(candidates.distinct()), "key", "left_semi")
        .groupBy("text_sha256")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_no")).alias("winner"), F.count("*").alias("size"))
        .select("text_sha256", F.col("winner.doc_id").alias("win_id"), F.col("winner.row_no").alias("win_row"), "size")
    )


def mark_duplicates(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row_no"),
        digest(text_col).alias("text_sha256"),
    )
    rows = stored(spark, rows, "digests")
    heavy = stored(spark, frequent(rows, support), "frequent-digests")
    marked = rows.join(F.broadcast(heavy), "text_sha256", "left")
    group = Window.partitionBy("text_sha256")
    rest = (
        marked.filter(F.col("size").isNull())
        .select("doc_id", "row_no", "text_sha256")
        .withColumn("winner", F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_no")).over(group))
        .withColumn("size", F.count("*").over(group))
        .select("doc_id", "row_no", "text_sha256", F.col("winner.doc_id").alias("win_id"), F.col("winner.row_no").alias("win_row"), "size")
    )
    settled = marked.filter(F.col("size").isNotNull()).select(*rest.columns)
    return settled.unionByName(rest).select(
        "doc_id",
        F.col("win_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row_no") == F.col("win_row")).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT
) -> DataFrame:
    """The documents that stay, with all their columns.

    Losing copies of frequent texts go before the shuffle; the rows that are left are
    shuffled once, by digest.
    """
    mark, order = "__digest", "__rank"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("row_no"), digest(text_col).alias("text_sha256"))
    heavy = stored(spark, frequent(rows, support), "frequent-digests").select(
        F.col("text_sha256").alias("__heavy"), F.col("win_id").alias("__win_id")
    )
    marked = docs.withColumn(mark, digest(text_col)).join(
        F.broadcast(heavy), F.col(mark) == F.col("__heavy"), "left"
    )
    left = marked.filter(F.col("__heavy").isNull() | F.col(id_col).eqNullSafe(F.col("__win_id")))
    first = Window.partitionBy(mark).orderBy(F.col(id_col).asc_nulls_last())
    return left.withColumn(order, F.row_number().over(first)).filter(F.col(order) == 1).select(*[F.col(c) for c in docs.columns])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(spark, documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
