"""Distress models on MLlib: training, scoring, importances, drivers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.dataset import FEATURES, risk_level

SEED = 7
REG_PARAM = 0.01


def _classifier(kind: str, features: list[str], label: str, weight: str | None):
    common = {"featuresCol": "features", "labelCol": label}
    weighted = {**common, "weightCol": weight} if weight else common
    if kind == "lr":
        return LogisticRegression(**weighted, regParam=REG_PARAM, elasticNetParam=0.0, maxIter=50)
    if kind == "rf":
        return RandomForestClassifier(**weighted, numTrees=30, maxDepth=6, seed=SEED)
    if kind == "gbt":
        return GBTClassifier(**weighted, maxIter=15, maxDepth=4, seed=SEED)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(**common, layers=[len(features), 8, 2], maxIter=50, seed=SEED)
    raise ValueError(f"unknown model kind {kind!r}")


def train(
    rows: DataFrame,
    kind: str,
    features: list[str] = FEATURES,
    label: str = "distress_label",
    weight: str | None = "weight",
) -> PipelineModel:
    """Fit one model. Missing features take the training mean; all features are scaled."""
    filled = [f"{f}_filled" for f in features]
    stages = [
        Imputer(inputCols=features, outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        _classifier(kind, features, label, weight),
    ]
    return Pipeline(stages=stages).fit(rows)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Distress probability in percent and risk level for every row."""
    scored = model.transform(rows)
    percent = vector_to_array("probability")[1] * 100
    return scored.withColumn("probability_pct", F.round(percent, 4)).withColumn(
        "risk_level", risk_level(F.col("probability_pct"))
    )


def feature_importance(spark, model: PipelineModel, features: list[str] = FEATURES) -> DataFrame:
    """One row per feature, ranked: tree importances or absolute scaled coefficients."""
    fitted = model.stages[-1]
    if hasattr(fitted, "featureImportances"):
        weights = fitted.featureImportances.toArray()
    else:
        weights = abs(fitted.coefficients.toArray())
        weights = weights / weights.sum()
    ranked = sorted(zip(features, map(float, weights)), key=lambda pair: -pair[1])
    rows = [(i, name, value) for i, (name, value) in enumerate(ranked, 1)]
    return spark.createDataFrame(rows, "rank int, feature_name string, importance double")


@dataclass(frozen=True)
class Linear:
    """A logistic model in plain numbers, per feature in order."""

    means: tuple[float, ...]
    deviations: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float


def linear_of(model: PipelineModel) -> Linear:
    """The numbers of a fitted logistic regression: gap filler, scaler and coefficients."""
    imputer, _, scaler, fitted = model.stages
    fill = imputer.surrogateDF.first()
    return Linear(
        tuple(float(fill[c]) for c in imputer.getInputCols()),
        tuple(float(d) or 1.0 for d in scaler.std.toArray()),
        tuple(float(c) for c in fitted.coefficients.toArray()),
        float(fitted.intercept),
    )


def lr_gradient(
    rows: DataFrame, coefficients: list[float], intercept: float, label: str, weight: str, penalty: float = REG_PARAM
) -> DataFrame:
    """Gradient of the logistic objective, as (parameter number, gradient, gradient at zero).

    ``rows`` have the scaled vector ``features``. The objective is the weighted mean log loss plus
    half the penalty on coefficients times their feature's weighted deviation, as MLlib fits
    it; the last parameter is the constant. One aggregate over the rows; all entries near
    zero certify that the fit has reached its optimum.
    """
    x, w, y = vector_to_array("features"), F.col(weight), F.col(label)
    score = reduce(lambda a, b: a + b, [F.lit(c) * x[j] for j, c in enumerate(coefficients)], F.lit(intercept))
    base = rows.select(x.alias("_x"), w.alias("_w"), (1 / (1 + F.exp(-score)) - y).alias("_off"), (F.lit(0.5) - y).alias("_off0"))
    total, squares = F.sum("_w"), F.sum(F.col("_w") * F.col("_w"))
    columns = []
    for j, c in enumerate(coefficients):
        v = F.col("_x")[j]
        spread = (F.sum(F.col("_w") * v * v) - F.pow(F.sum(F.col("_w") * v), 2) / total) / (total - squares / total)
        columns.append(
            F.struct(
                F.lit(j).alias("parameter"),
                (F.sum(F.col("_w") * F.col("_off") * v) / total + F.lit(penalty * c) * spread).alias("gradient"),
                (F.sum(F.col("_w") * F.col("_off0") * v) / total).alias("at_zero"),
            )
        )
    columns.append(
        F.struct(
            F.lit(len(coefficients)).alias("parameter"),
            (F.sum(F.col("_w") * F.col("_off")) / total).alias("gradient"),
            (F.sum(F.col("_w") * F.col("_off0")) / total).alias("at_zero"),
        )
    )
    return base.agg(F.array(*columns).alias("_all")).select(F.inline("_all"))


def _impacts(model: Linear, features: list[str]) -> list[Column]:
    """What each feature adds to the score: coefficient times scaled value; a gap adds nothing."""
    parts = zip(features, model.means, model.deviations, model.coefficients)
    return [F.lit(c) * ((F.coalesce(F.col(f), F.lit(m)) - F.lit(m)) / F.lit(d)) for f, m, d, c in parts]


def linear_score(model: Linear, rows: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Distress probability in percent and risk level, as plain column arithmetic."""
    total = reduce(lambda a, b: a + b, _impacts(model, features), F.lit(model.intercept))
    percent = F.round(F.lit(100.0) / (1 + F.exp(-total)), 4)
    return rows.withColumn("probability_pct", percent).withColumn("risk_level", risk_level(F.col("probability_pct")))


def risk_factors(
    model: Linear, scored: DataFrame, top: int = 3, features: list[str] = FEATURES
) -> DataFrame:
    """The strongest drivers of each row's score; no rows are multiplied or shuffled."""
    impacts = F.array(
        *[
            F.struct(
                F.abs(impact).alias("strength"), F.lit(name).alias("factor_name"), F.round(impact, 6).alias("impact")
            )
            for name, impact in zip(features, _impacts(model, features))
        ]
    )
    strongest = F.slice(F.reverse(F.array_sort(impacts)), 1, top)
    listed = F.transform(
        strongest,
        lambda f: F.struct(
            f["factor_name"].alias("factor_name"),
            F.when(f["impact"] > 0, "NEGATIVE").otherwise("POSITIVE").alias("impact_type"),
            f["impact"].alias("impact"),
        ),
    )
    return scored.select("ticker", "year", "probability_pct", "risk_level", listed.alias("risk_factors"))
