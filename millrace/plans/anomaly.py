"""Contextual anomaly detection on a store panel, judged on labels kept apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.values import log_ratio
from millrace.operators import forest, hygiene, metrics
from millrace.operators.clusters import assemble
from millrace.operators.trees import fit_trees

# Context of the expected volume and the detector's settings.
CONTEXT = (
    "store_type", "promo_flag", "day_of_week", "local_holiday", "temperature", "competitor_distance",
    "inventory_level", "customer_rating", "region",
)
CONTAMINATION, TREES = 0.052, 300
RESIDUALS = ["sales_residual", "sales_log_ratio", "temperature"]


@dataclass
class Detector:
    scored: DataFrame
    forest: forest.IsolationForest
    regressor: GBTRegressionModel
    cut: float


def residual_features(
    df: DataFrame, target: str = "units_sold", context=CONTEXT, regressor: GBTRegressionModel | None = None, max_iter: int = 100
) -> tuple[DataFrame, GBTRegressionModel]:
    """Residual and log ratio of the observed against the expected volume given the context; no labels used."""
    present = [c for c in context if c in df.columns]
    texts = [c for c in present if isinstance(df.schema[c].dataType, T.StringType)]
    levels = hygiene.category_levels(df, texts) if texts else {}
    dummies = hygiene.one_hot(df.select("*", *[F.col(c).alias(f"_c_{c}") for c in texts]), {f"_c_{c}": v for c, v in levels.items()})
    columns = [c for c in present if c not in texts] + [c for c in dummies.columns if c.startswith("_c_")]
    ready = assemble(dummies, columns).persist()
    if regressor is None:
        data = ready.select("features", F.col(target).cast("double").alias("label"))
        regressor = fit_trees(data, maxIter=max_iter, maxDepth=5, stepSize=0.1, seed=42)
    expected, actual = F.col("prediction"), F.col(target).cast("double")
    out = regressor.transform(ready).withColumns({
        "sales_residual": actual - expected, "sales_log_ratio": log_ratio(actual, expected),
    })
    return out.drop("features", "prediction", *[c for c in dummies.columns if c.startswith("_c_")]), regressor


def detect(
    df: DataFrame, target: str = "units_sold", id_col: str | None = None, contamination: float = CONTAMINATION,
    trees: int = TREES, seed: int = 42, context=CONTEXT, max_iter: int = 100,
) -> Detector:
    features, regressor = residual_features(df, target, context, max_iter=max_iter)
    names = [c for c in RESIDUALS if c in features.columns]
    features = features.persist()
    grown = forest.fit_forest(features, names, trees, seed, id_col)
    scored, cut = forest.flag_outliers(grown.score(features).persist(), contamination)
    return Detector(scored, grown, regressor, cut)


def evaluate(scored: DataFrame, labels: DataFrame, key: str = "row_index", flag: str = "is_anomaly") -> DataFrame:
    """Confusion counts, precision, recall, F1 and the gate. Labels meet the scores by key, never by position."""
    joined = scored.join(labels.select(key, F.col(flag).cast("boolean").alias(flag)), key)
    return metrics.detector_gate(metrics.confusion(joined, flag, "is_outlier"))
