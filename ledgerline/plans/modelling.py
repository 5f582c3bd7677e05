"""Dataset assembly, model training, scoring and evaluation queries."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import companies as company_ops
from ledgerline.operators import dataset as ds
from ledgerline.operators import evaluation, labels, models, ratios
from ledgerline.plans.fundamentals import LABEL_PARTS, loss_dataset, statements
from ledgerline.plans.inputs import COMPANIES_SQL, companies, layer
from ledgerline.plans.registry import Catalog, with_parts
from ledgerline.session import configure, source_version, work_dir
from ledgerline.sinks.reports import DATASET_HEADINGS, write_dataset

modelling = Catalog()

TRAIN, TEST = (1995, 1999), (2000, 2001)

DATASET_SQL = """
dataset AS (
  SELECT r.ticker, c.name AS company_name, r.year, c.exchange, c.industry, r.roa, r.roe, r.current_ratio, r.debt_to_ta,
         r.ebit_margin, r.log_total_assets, round(l.z_score, 4) AS z_score, CAST(l.distress_label AS INT) AS distress_label
  FROM ratios r JOIN labelled l ON l.ticker = r.ticker AND l.year = r.year
       LEFT JOIN companies c ON c.ticker = r.ticker)
"""
# A fixed score that both engines compute alike; evaluation does not depend on a fit.
FIXED_SQL = """
fixed AS (
  SELECT *, round(1 / (1 + exp(0.8e0 * roa / 10 + 0.3e0 * current_ratio - 2.0e0 * debt_to_ta)), 3) AS probability FROM dataset)
"""


def dataset_oracle(body: str, *more: str) -> str:
    return with_parts(*LABEL_PARTS, COMPANIES_SQL, DATASET_SQL, *more, body=body)


def _build_dataset(spark, sf_dir):
    """The ratios a dataset keeps need no year before: columns of a row, not worth a stored layer."""
    rows = statements(spark, sf_dir)
    return ds.assemble(ratios.ratios(rows), labels.distress_labels(rows), companies(spark, sf_dir))


def dataset(spark, sf_dir):
    return layer(spark, sf_dir, "dataset", _build_dataset)


def fixed_scores(spark, sf_dir):
    linear = (
        F.lit(0.8) * F.col("roa") / 10 + F.lit(0.3) * F.col("current_ratio") - F.lit(2.0) * F.col("debt_to_ta")
    )
    return dataset(spark, sf_dir).withColumn(
        "probability", F.round(F.lit(1) / (1 + F.exp(linear)), 3)
    )


@modelling.query("dataset_assemble", dataset_oracle("SELECT * FROM dataset"))
def dataset_assemble(spark, sf_dir):
    configure(spark)
    return _build_dataset(spark, sf_dir)


_MISSING = " + ".join(f"CASE WHEN {f} IS NULL THEN 1 ELSE 0 END" for f in ds.FEATURES)


@modelling.query(
    "dataset_summary",
    dataset_oracle(
        f"""SELECT count(*) AS total_rows, count(DISTINCT ticker) AS total_companies, min(year) AS first_year, max(year) AS last_year,
                   count(*) FILTER (WHERE distress_label = 0) AS label_0_count, count(*) FILTER (WHERE distress_label = 1) AS label_1_count,
                   round(count(*) FILTER (WHERE distress_label = 1) * 100.0 / count(*), 4) AS distress_ratio_pct,
                   round(CAST(count(*) FILTER (WHERE distress_label = 0) AS DOUBLE) / count(*) FILTER (WHERE distress_label = 1), 4) AS imbalance_ratio,
                   round(CAST(sum({_MISSING}) AS DOUBLE) * 100.0 / (count(*) * {len(ds.FEATURES)}), 4) AS missing_rate_overall
            FROM dataset"""
    ),
)
def dataset_summary(spark, sf_dir):
    return ds.summary(dataset(spark, sf_dir))


@modelling.query(
    "dataset_search",
    dataset_oracle(
        "SELECT * FROM dataset WHERE distress_label = 1 AND (contains(lower(ticker), '77') OR contains(lower(company_name), '77'))"
    ),
)
def dataset_search(spark, sf_dir):
    rows = dataset(spark, sf_dir)
    found = company_ops.search(rows, "77", ["ticker", "company_name"])
    return company_ops.facets(found.withColumn("_l", F.col("distress_label").cast("string")), _l="1").drop("_l")


def _export(form: str):
    def run(spark, sf_dir):
        rows = dataset(spark, sf_dir)
        path = work_dir(configure(spark), "dataset")
        write_dataset(rows, path, form)
        schema = rows.select(*DATASET_HEADINGS).schema
        if form == "parquet":
            return spark.read.parquet(path)
        sep = "," if form == "csv" else "\t"
        return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)

    return run


for _form in ["csv", "excel", "parquet"]:
    modelling.query(f"dataset_export_{_form}", dataset_oracle("SELECT * FROM dataset"))(_export(_form))


@modelling.query(
    "time_split",
    dataset_oracle(
        f"""SELECT ticker, year, CASE WHEN year <= {TRAIN[1]} THEN 'train' ELSE 'test' END AS part FROM dataset
            WHERE year BETWEEN {TRAIN[0]} AND {TEST[1]}"""
    ),
)
def time_split(spark, sf_dir):
    train, test = ds.time_split(dataset(spark, sf_dir), TRAIN, TEST)
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return parts.select("ticker", "year", "part")


@modelling.query(
    "class_weight",
    dataset_oracle(
        """SELECT ticker, year, distress_label, round((SELECT count(*) FROM dataset) / (2.0 * count(*) OVER (PARTITION BY distress_label)), 6) AS weight
           FROM dataset"""
    ),
)
def class_weight(spark, sf_dir):
    weighted = ds.class_weight(dataset(spark, sf_dir))
    return weighted.select("ticker", "year", "distress_label", F.round("weight", 6).alias("weight"))


# ---------------------------------------------------------------- evaluation on a fixed score

_CONFUSION = """count(*) FILTER (WHERE probability > 0.5 AND distress_label = 1) AS tp, count(*) FILTER (WHERE probability > 0.5 AND distress_label = 0) AS fp,
    count(*) FILTER (WHERE probability <= 0.5 AND distress_label = 0) AS tn, count(*) FILTER (WHERE probability <= 0.5 AND distress_label = 1) AS fn"""
_METRICS = """round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall,
    round(2.0e0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1_score, round((tp + tn) / nullif(CAST(tp + fp + tn + fn AS DOUBLE), 0), 6) AS accuracy"""


@modelling.query(
    "confusion_matrix", dataset_oracle(f"SELECT year, {_CONFUSION} FROM fixed GROUP BY year", FIXED_SQL)
)
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(fixed_scores(spark, sf_dir), ["year"], "probability", "distress_label")


@modelling.query(
    "class_metrics",
    dataset_oracle(
        f"SELECT year, tp, fp, tn, fn, {_METRICS} FROM (SELECT year, {_CONFUSION} FROM fixed GROUP BY year) c",
        FIXED_SQL,
    ),
)
def class_metrics(spark, sf_dir):
    return evaluation.class_metrics(confusion_matrix(spark, sf_dir))


ROC_SQL = """
roc AS (
  SELECT industry, probability, pos, neg, sum(pos) OVER u AS tp, sum(neg) OVER u AS fp,
         sum(pos) OVER (PARTITION BY industry) AS positives, sum(neg) OVER (PARTITION BY industry) AS negatives
  FROM (SELECT industry, probability, count(*) FILTER (WHERE distress_label = 1) AS pos,
               count(*) FILTER (WHERE distress_label = 0) AS neg FROM fixed GROUP BY industry, probability) s
  WINDOW u AS (PARTITION BY industry ORDER BY probability DESC)),
aucs AS (
  SELECT industry, round(sum((tp + prev_tp) / 2.0e0 * (fp - prev_fp)) / max(positives * CAST(negatives AS DOUBLE)), 6) AS auc
  FROM (SELECT *, coalesce(lag(tp) OVER w, 0) AS prev_tp, coalesce(lag(fp) OVER w, 0) AS prev_fp FROM roc
        WINDOW w AS (PARTITION BY industry ORDER BY probability DESC)) t GROUP BY industry)
"""


def _roc(spark, sf_dir):
    return evaluation.roc_points(fixed_scores(spark, sf_dir), ["industry"], "probability", "distress_label")


@modelling.query(
    "roc_points",
    dataset_oracle(
        """SELECT industry, probability, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
                  round(tp / nullif(CAST(positives AS DOUBLE), 0), 6) AS tpr, round(fp / nullif(CAST(negatives AS DOUBLE), 0), 6) AS fpr FROM roc""",
        FIXED_SQL,
        ROC_SQL,
    ),
)
def roc_points(spark, sf_dir):
    return _roc(spark, sf_dir).select(
        "industry", "probability", "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr")
    )


@modelling.query("roc_auc", dataset_oracle("SELECT * FROM aucs", FIXED_SQL, ROC_SQL))
def roc_auc(spark, sf_dir):
    return evaluation.roc_auc(_roc(spark, sf_dir), ["industry"])


@modelling.query(
    "segment_eval",
    dataset_oracle(
        f"""SELECT industry, tp, fp, tn, fn, {_METRICS}, auc FROM (SELECT industry, {_CONFUSION} FROM fixed GROUP BY industry) c
            JOIN aucs USING (industry)""",
        FIXED_SQL,
        ROC_SQL,
    ),
)
def segment_eval(spark, sf_dir):
    scored = fixed_scores(spark, sf_dir)
    counts = evaluation.confusion_matrix(scored, ["industry"], "probability", "distress_label")
    return evaluation.class_metrics(counts).join(roc_auc(spark, sf_dir), "industry")


# ---------------------------------------------------------------- scores of companies

SCORES_SQL = """
scores AS (
  SELECT ticker, year, round(probability * 100, 4) AS probability_pct,
         CASE WHEN round(probability * 100, 4) < 10 THEN 'LOW' WHEN round(probability * 100, 4) <= 50 THEN 'MODERATE' ELSE 'HIGH' END AS risk_level
  FROM fixed)
"""


def _scores(spark, sf_dir):
    percent = F.round(F.col("probability") * 100, 4)
    return fixed_scores(spark, sf_dir).select(
        "ticker", "year", percent.alias("probability_pct"), ds.risk_level(percent).alias("risk_level")
    )


@modelling.query("risk_level", dataset_oracle("SELECT * FROM scores", FIXED_SQL, SCORES_SQL))
def risk_level(spark, sf_dir):
    return _scores(spark, sf_dir)


@modelling.query(
    "risk_trend",
    dataset_oracle(
        """SELECT *, CASE WHEN change < 0 THEN 'down' WHEN change > 0 THEN 'up' WHEN change = 0 THEN 'flat' END AS direction
           FROM (SELECT ticker, year, probability_pct, risk_level,
                        round(probability_pct - lag(probability_pct) OVER w, 4) AS change, count(*) OVER w AS periods
                 FROM scores WINDOW w AS (PARTITION BY ticker ORDER BY year)) t""",
        FIXED_SQL,
        SCORES_SQL,
    ),
)
def risk_trend(spark, sf_dir):
    trend = ds.risk_trend(_scores(spark, sf_dir))
    return trend.withColumn("periods", F.size("history").cast("bigint")).drop("history")


@modelling.query(
    "risk_screen",
    dataset_oracle(
        "SELECT * FROM scores WHERE risk_level = 'HIGH'",
        FIXED_SQL,
        SCORES_SQL,
    ),
)
def risk_screen(spark, sf_dir):
    return ds.risk_screen(_scores(spark, sf_dir), "HIGH")


@modelling.query(
    "risk_screen_top",
    dataset_oracle(
        "SELECT * FROM scores WHERE risk_level = 'HIGH' ORDER BY probability_pct DESC, ticker, year LIMIT 50",
        FIXED_SQL,
        SCORES_SQL,
    ),
)
def risk_screen_top(spark, sf_dir):
    """The fifty riskiest, as a report."""
    return ds.risk_screen(_scores(spark, sf_dir), "HIGH", top=50)


# ---------------------------------------------------------------- fitted models


_MODELS: dict[tuple, str] = {}


def _saved(spark, sf_dir, name: str, fit) -> PipelineModel:
    """A model that is fitted and saved once per state of the input, then loaded."""
    key = (spark.sparkContext.applicationId, sf_dir, source_version(spark, sf_dir), name)
    if key not in _MODELS:
        path = work_dir(spark, f"model-{name}")
        fit().write().save(path)
        _MODELS[key] = path
    return PipelineModel.load(_MODELS[key])


def _weighted(train, kind: str):
    return train.withColumn("weight", F.lit(1.0)) if kind == "mlp" else ds.class_weight(train)


def _fitted(spark, sf_dir, kind: str):
    """The model of a kind, and the rows it has not seen."""
    train, test = ds.time_split(dataset(spark, sf_dir), TRAIN, TEST)
    return _saved(spark, sf_dir, kind, lambda: models.train(_weighted(train, kind), kind)), test


def _quality(model, rows, name: str, label: str):
    """Class metrics and AUC of a model on rows it has not seen."""
    # Tied to a column: a constant key would turn the joins on it into cross joins.
    named = F.when(F.col("ticker").isNotNull(), F.lit(name))
    scored = models.score(model, rows).withColumn("model", named)
    counts = evaluation.confusion_matrix(scored, ["model"], "probability_pct", label, 50.0)
    points = evaluation.roc_points(scored, ["model"], "probability_pct", label, listed_keys=True)
    auc = evaluation.roc_auc(points, ["model"])
    return evaluation.class_metrics(counts).join(F.broadcast(auc), "model")


def _trained(kind: str):
    def run(spark, sf_dir):
        """Quality of the model on the later years."""
        model, test = _fitted(spark, sf_dir, kind)
        return _quality(model, test, kind, "distress_label")

    return run


for _kind in ["lr", "rf", "gbt", "mlp"]:
    modelling.query(f"train_{_kind}")(_trained(_kind))


# The fit is stationary where no entry of the gradient exceeds this share of the largest at zero.
STATIONARY = 1e-3


@modelling.query(
    "lr_optimum",
    " UNION ALL ".join(f"SELECT '{name}' AS parameter, true AS stationary" for name in [*ds.FEATURES, "constant"]),
)
def lr_optimum(spark, sf_dir):
    """Certificate of the logistic fit: its objective's gradient on the training rows vanishes."""
    model, _ = _fitted(spark, sf_dir, "lr")
    train, _ = ds.time_split(dataset(spark, sf_dir), TRAIN, TEST)
    fitted = model.stages[-1]
    scaled = PipelineModel(model.stages[:-1]).transform(_weighted(train, "lr"))
    gradient = models.lr_gradient(
        scaled, [float(c) for c in fitted.coefficients], float(fitted.intercept), "distress_label", "weight"
    )
    names = F.array(*[F.lit(n) for n in [*ds.FEATURES, "constant"]])
    # One row per parameter: eight in all.
    largest = F.max(F.abs("at_zero")).over(Window.partitionBy())
    return gradient.select(
        names[F.col("parameter")].alias("parameter"), (F.abs("gradient") <= STATIONARY * largest).alias("stationary")
    )


@modelling.query("train_loss")
def train_loss(spark, sf_dir):
    """Next-quarter loss model: quality on the later years."""
    train, test = ds.time_split(loss_dataset(spark, sf_dir), TRAIN, TEST)
    features, label = ratios.LOSS_FEATURES, "is_loss"
    model = _saved(
        spark, sf_dir, "loss", lambda: models.train(ds.class_weight(train, label), "rf", features, label)
    )
    return _quality(model, test, "loss_rf", label)


@modelling.query("feature_importance")
def feature_importance(spark, sf_dir):
    return models.feature_importance(spark, _fitted(spark, sf_dir, "rf")[0])


@modelling.query("score_companies")
def score_companies(spark, sf_dir):
    model, _ = _fitted(spark, sf_dir, "lr")
    return models.score(model, dataset(spark, sf_dir)).select(
        "ticker", "company_name", "year", "probability_pct", "risk_level"
    )


@modelling.query("risk_factors")
def risk_factors(spark, sf_dir):
    model, _ = _fitted(spark, sf_dir, "lr")
    return models.risk_factors(models.linear_of(model), models.score(model, dataset(spark, sf_dir)))


# ---------------------------------------------------------------- a given model, which SQL can repeat

GIVEN = models.Linear(
    means=(6.0, 11.0, 1.6, 0.6, 30.0, 5.5, 3.0),
    deviations=(9.1730291, 20.3718233, 0.8123417, 0.1517193, 12.1390727, 0.4139281, 1.1371903),
    coefficients=(-0.7129317, -0.2193711, -0.3512903, 0.9173219, -0.1531907, 0.1093713, -1.2190337),
    intercept=-0.4,
)
_PARTS = [
    f"{c!r}e0 * ((coalesce({f}, {m!r}e0) - {m!r}e0) / {d!r}e0)"
    for f, m, d, c in zip(ds.FEATURES, GIVEN.means, GIVEN.deviations, GIVEN.coefficients)
]
GIVEN_SQL = f"""
judged AS (
  SELECT *, round(100e0 / (1 + exp(-({GIVEN.intercept!r}e0 + {" + ".join(_PARTS)}))), 4) AS probability_pct FROM dataset),
given_scores AS (
  SELECT *, CASE WHEN probability_pct < 10 THEN 'LOW' WHEN probability_pct <= 50 THEN 'MODERATE' ELSE 'HIGH' END AS risk_level
  FROM judged)
"""


@modelling.query(
    "scores_given",
    dataset_oracle("SELECT ticker, company_name, year, probability_pct, risk_level FROM given_scores", GIVEN_SQL),
)
def scores_given(spark, sf_dir):
    """Scores of all companies by a model given as numbers."""
    scored = models.linear_score(GIVEN, dataset(spark, sf_dir))
    return scored.select("ticker", "company_name", "year", "probability_pct", "risk_level")


@modelling.query(
    "risk_factors_given",
    dataset_oracle(
        """SELECT ticker, year, probability_pct, risk_level, CAST(place AS INT) AS place, factor_name,
                  CASE WHEN round(raw, 6) > 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END AS impact_type, round(raw, 6) AS impact
           FROM (SELECT *, row_number() OVER (PARTITION BY ticker, year ORDER BY abs(raw) DESC, factor_name DESC) AS place FROM ("""
        + " UNION ALL ".join(
            f"SELECT ticker, year, probability_pct, risk_level, '{f}' AS factor_name, {part} AS raw FROM given_scores"
            for f, part in zip(ds.FEATURES, _PARTS)
        )
        + ") u) r WHERE place <= 3",
        GIVEN_SQL,
    ),
)
def risk_factors_given(spark, sf_dir):
    """The three strongest drivers of each score, one row each."""
    factors = models.risk_factors(GIVEN, models.linear_score(GIVEN, dataset(spark, sf_dir)))
    each = factors.select(
        "ticker", "year", "probability_pct", "risk_level", F.posexplode("risk_factors").alias("at", "factor")
    )
    return each.select(
        "ticker", "year", "probability_pct", "risk_level", (F.col("at") + 1).alias("place"), "factor.*"
    )
