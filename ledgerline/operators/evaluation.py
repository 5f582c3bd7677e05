"""Scoring quality: confusion counts, class metrics, ROC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numeric import ratio
from ledgerline.operators.quantiles import in_ranges
from ledgerline.operators.series import running_sums


def confusion_matrix(
    scored: DataFrame, keys: list[str], probability: str, label: str, threshold: float = 0.5
) -> DataFrame:
    """True and false positives and negatives per key."""
    said = F.col(probability) > threshold
    true = F.col(label) == 1
    return scored.groupBy(*keys).agg(
        F.count_if(said & true).alias("tp"),
        F.count_if(said & ~true).alias("fp"),
        F.count_if(~said & ~true).alias("tn"),
        F.count_if(~said & true).alias("fn"),
    )


def class_metrics(confusion: DataFrame, digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and accuracy; null where nothing can be divided."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ["tp", "fp", "tn", "fn"])

    def rounded(value: Column) -> Column:
        return F.round(value, digits)

    return confusion.withColumns(
        {
            "precision": rounded(ratio(tp, tp + fp)),
            "recall": rounded(ratio(tp, tp + fn)),
            "f1_score": rounded(ratio(2 * tp, 2 * tp + fp + fn)),
            "accuracy": rounded(ratio(tp + tn, tp + fp + tn + fn)),
        }
    )


def roc_points(
    scored: DataFrame, keys: list[str], score: str, label: str, listed_keys: bool = False
) -> DataFrame:
    """One point per distinct score, from the highest down; equal scores count together.

    Scores are pre-aggregated, then accumulated range by range: no task orders all scores.
    ``listed_keys`` says that the keys come from a written-down list, so that their totals
    may be broadcast instead of gathering a key's scores in one task.
    """
    true = F.col(label) == 1
    counts = scored.groupBy(*keys, score).agg(
        F.count_if(true).alias("pos"), F.count_if(~true).alias("neg")
    )
    ascending = in_ranges(counts, keys, score)
    ranged = ascending.withColumn("_bin", -F.col("_bin"))
    sums = {"tp": F.col("pos"), "fp": F.col("neg")}
    points = running_sums(ranged, keys, [F.col(score).desc()], "_bin", sums).drop("_bin")
    totals = scored.groupBy(*keys).agg(
        F.count_if(true).alias("positives"), F.count_if(~true).alias("negatives")
    )
    joined = points.join(F.broadcast(totals) if listed_keys else totals, keys)
    return joined.withColumns(
        {
            "tpr": ratio(F.col("tp").cast("double"), F.col("positives").cast("double")),
            "fpr": ratio(F.col("fp").cast("double"), F.col("negatives").cast("double")),
        }
    )


def roc_auc(points: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Area under the points by trapezoids: width from the negatives of a score, height
    half way through its positives."""
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    return points.groupBy(*keys).agg(
        F.round(ratio(F.sum(area), F.first("positives").cast("double") * F.first("negatives")), digits).alias("auc")
    )
