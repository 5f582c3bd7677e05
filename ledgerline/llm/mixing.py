"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of its copies in the mix. Among all rates of at most
``most`` that give each source its target of words, those closest in entropy to one copy each
are exponentials of the document's size, tilted by one multiplier per source and cut at
``most``. The multipliers solve the convex dual: each Newton iteration is one aggregate over
the counts of documents per (source, size), for all sources at once, with a bracket that
halves when a step leaves it.

Rates become whole copies by carrying the rounding error of a source from its long documents
to its short ones, so what is taken ends within about its shortest document of the target.
Documents of one size in one source share their copies by rank of a hash of the id; ranks are
counted over salted parts, so a size that a third of all rows have is no single group.

Size is the number of words; null text has none and its one copy counts nothing. A null source
is a source of its own, last in order. Repeated rows are documents of their own. Without any
word every target is 0. An empty table gives an empty result. Columns beside doc_id, text and
source may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD, documents, empty_if_null, stored

WEIGHTS = (1, 2, 3)
MOST = 3

# Newton ends when every source is this close to its target, or after so many rounds.
CLOSE = 1e-6
ROUNDS = 40

SALTS = 256


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(empty_if_null("text"), F.lit(WORD)).cast("long").alias("size"),
    )


def source_targets(spark: SparkSession, counts: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n_docs, target: weights in order of the sources, shares capped and reshared.

    Raising one level until the capped shares sum to the whole is what resharing by weight ends
    at; each round is one aggregate over the sources.
    """
    by_source = counts.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")
    )
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    listed = stored(
        spark,
        by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn(
            "cap", F.col("source_size") * float(most)
        ),
        "sources",
    )
    total = listed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        if capped < 0:
            over = F.lit(False)
        full, free, now = listed.agg(
            F.sum(F.when(over, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))),
            F.count(F.when(over, 1)),
        ).first()
        if now == capped or not free:
            break
        level, capped = (total - full) / free, now
    return listed.withColumn("target", F.least("cap", F.lit(level) * F.col("weight")))


def rate_of(tilt, size, mean_size, most: int = MOST):
    """min(most, exp(tilt * size / mean size)) without overflow."""
    return F.exp(F.least(tilt * size / mean_size, F.lit(math.log(most))))


def solve_tilts(spark: SparkSession, cells: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """source, tilt, full: the dual's multiplier of each source by safeguarded Newton steps.

    ``cells`` counts documents per (source, size). ``full`` marks sources whose target is all
    that copies can give; there the multiplier has no finite value.
    """
    mean = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9))
    state = stored(
        spark,
        targets.select(
            "source",
            "target",
            mean.alias("mean_size"),
            (F.col("target") >= F.col("cap") * (1 - 1e-12)).alias("full"),
            F.log(F.greatest(F.col("target") / F.greatest("source_size", F.lit(1)), F.lit(1e-12))).alias("tilt"),
            F.lit(-1e4).alias("low"),
            (F.lit(1.2) * mean).alias("high"),
            F.lit(1.0).alias("off"),
        ),
        "tilts",
    )
    words = F.col("size") * F.col("n")
    for _ in range(ROUNDS):
        scaled = F.col("size") / F.col("mean_size")
        rate = rate_of(F.col("tilt"), F.col("size"), F.col("mean_size"), most)
        below = F.col("tilt") * scaled < math.log(most)
        given = (
            cells.join(state, F.col("c_source").eqNullSafe(F.col("source")))
            .filter(~F.col("full") & (F.col("target") > 0))
            .groupBy("source", "target", "mean_size", "full", "tilt", "low", "high")
            .agg(F.sum(words * rate).alias("f"), F.sum(F.when(below, words * rate * scaled).otherwise(0.0)).alias("slope"))
        )
        low = F.when(F.col("f") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("f") >= F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - (F.log("f") - F.log("target")) * F.col("f") / F.greatest("slope", F.lit(1e-300))
        moved = given.select(
            "source",
            "target",
            "mean_size",
            "full",
            low.alias("low"),
            high.alias("high"),
            step.alias("step"),
            (F.abs(F.col("f") - F.col("target")) / F.col("target")).alias("off"),
            F.col("tilt").alias("old"),
        ).select(
            "source",
            "target",
            "mean_size",
            "full",
            F.when(F.col("off") <= CLOSE, F.col("old"))
            .when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step"))
            .otherwise((F.col("low") + F.col("high")) / 2)
            .alias("tilt"),
            "low",
            "high",
            "off",
        )
        rest = state.filter(F.col("full") | (F.col("target") <= 0)).withColumn("off", F.lit(0.0))
        state = stored(spark, moved.unionByName(rest), "tilts")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= CLOSE:
            break
    return state


def whole_copies(rows: pd.DataFrame, most: int = MOST) -> pd.DataFrame:
    """Copies of each (source, size): rounding errors go on from long to short documents.

    One row per distinct size, so a source's rows here are bounded by its longest document.
    """
    rows = rows.sort_values("size", ascending=False, ignore_index=True)
    copies, error = np.zeros(len(rows), dtype=np.int64), 0.0
    for i, (size, n, rate) in enumerate(zip(rows["size"], rows["n"], rows["rate"])):
        if not size:
            copies[i] = n
            continue
        copies[i] = min(max(round(n * rate + error / size), 0), most * n)
        error += (n * rate - copies[i]) * size
    return rows[["c_source", "size", "n"]].assign(copies=copies)


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per document."""
    rows = stored(spark, sizes(docs), "sizes")
    cells = stored(
        spark,
        rows.groupBy(F.col("source").alias("c_source"), "size").agg(F.count("*").alias("n")),
        "size-counts",
    )
    targets = stored(spark, source_targets(spark, cells.withColumnRenamed("c_source", "source"), weights, most), "targets")
    tilts = solve_tilts(spark, cells, targets, most)
    rate = (
        F.when(F.col("full"), float(most))
        .when(F.col("target") <= 0, 0.0)
        .otherwise(rate_of(F.col("tilt"), F.col("size"), F.col("mean_size"), most))
    )
    rated = cells.join(tilts, F.col("c_source").eqNullSafe(F.col("source"))).select("c_source", "size", "n", rate.alias("rate"))
    shared = rated.groupBy("c_source").applyInPandas(
        lambda pdf: whole_copies(pdf, most), "c_source string, size long, n long, copies long"
    )
    wanted = stored(
        spark,
        shared.join(targets, F.col("c_source").eqNullSafe(F.col("source"))).select(
            "c_source",
            F.col("size").alias("c_size"),
            F.expr("copies div n").alias("each"),
            F.expr("copies % n").alias("more"),
            "source_size",
            "target",
        ),
        "copies",
    )
    salted = rows.withColumn("mark", F.xxhash64("doc_id")).withColumn("salt", F.expr(f"pmod(mark, {SALTS})"))
    parts = salted.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(
        F.col("source").alias("b_source"),
        F.col("size").alias("b_size"),
        F.col("salt").alias("b_salt"),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"),
    )
    in_part = Window.partitionBy("source", "size", "salt").orderBy("mark", F.col("doc_id").asc_nulls_last())
    ranked = salted.withColumn("place", F.row_number().over(in_part) - 1).join(
        before,
        F.col("source").eqNullSafe(F.col("b_source"))
        & (F.col("size") == F.col("b_size"))
        & (F.col("salt") == F.col("b_salt")),
    )
    copies = F.col("each") + F.when(F.col("place") + F.col("before") < F.col("more"), 1).otherwise(0)
    return (
        ranked.join(wanted, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")))
        .withColumn("copies", copies)
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def mixed_documents(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns."""
    keys = ["doc_id", "source", "__size"]
    nth = Window.partitionBy(*keys).orderBy(F.lit(1))
    plan = (
        mix(spark, docs, weights, most)
        .withColumnRenamed("size", "__size")
        .withColumn("__nth", F.row_number().over(nth))
        .select(*[F.col(k).alias(f"__p{i}") for i, k in enumerate(keys)], F.col("__nth").alias("__pn"), F.col("copies").cast("int").alias("__copies"))
        .filter(F.col("__copies") > 0)
    )
    sized = docs.withColumn(
        "__size", F.regexp_count(empty_if_null("text"), F.lit(WORD)).cast("long")
    ).withColumn("__nth", F.row_number().over(nth))
    same = F.col("__nth") == F.col("__pn")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__p{i}"))
    return (
        sized.join(plan, same)
        .withColumn("__copy", F.explode(F.expr("array_repeat(1, __copies)")))
        .select(*[F.col(c) for c in docs.columns])
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
