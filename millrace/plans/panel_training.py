"""Pooled training on a store panel: time split, ridge and boosted trees, metrics without anomalies, gates, grids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import hygiene, metrics
from millrace.operators.clusters import assemble
from millrace.operators.lagging import panel_features
from millrace.operators.matrix import RidgeModel, column_facts, pooled_ridge, standardise
from millrace.operators.trees import fit_trees, from_boosted, predict_staged

# Pooled model settings, hard gates and search grids.
RIDGE_ALPHA = 10.0
BOOSTED = dict(maxIter=100, maxDepth=3, stepSize=0.05, seed=42)
RMSPE_GATE, R2_GATE = 15.0, 0.85
RIDGE_GRID = (0.1, 1.0, 5.0, 10.0, 50.0)
TREE_GRID = {"maxDepth": (3, 4, 5, 6), "maxIter": (100, 150, 200, 300), "stepSize": (0.05, 0.08, 0.1, 0.15, 0.2)}
CATEGORIES = ("store_type", "region")


def split_date(df: DataFrame, date: str = "date", validation: float = 0.20):
    """First validation date: 80 % of the distinct dates come before it. A bounded list of dates is ranked."""
    days = df.select(F.col(date).cast("date").alias("d")).where("d IS NOT NULL").distinct()
    ranked = days.select("d", (F.row_number().over(Window.orderBy("d")) - 1).alias("at"), F.count("d").over(Window.partitionBy()).alias("n"))
    return ranked.where(F.col("at") == F.floor(F.col("n") * (1.0 - validation))).first()["d"]


def time_split(df: DataFrame, date: str = "date", validation: float = 0.20, cutoff=None) -> tuple[DataFrame, DataFrame]:
    """Earlier dates train, later ones validate; the cutoff is a literal that reaches the scan."""
    cutoff = cutoff or split_date(df, date, validation)
    return df.where(F.col(date) < F.lit(cutoff)), df.where(F.col(date) >= F.lit(cutoff))


@dataclass
class TrainedPanel:
    models: dict[str, RidgeModel | GBTRegressionModel]
    features: list[str]
    predictions: DataFrame
    metrics: DataFrame


def feature_columns(df: DataFrame, target: str, key: str, date: str, levels: dict[str, list[str]]) -> list[str]:
    skip = {target, key, date, "row_index"}
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, T.NumericType)]


def training_folds(
    panel: DataFrame, key: str = "store_id", date: str = "date", target: str = "units_sold", validation: float = 0.20
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Panel features, time split, one-hot levels of the training fold: (train, validation, feature names)."""
    rows = panel_features(panel, key, date, target).persist()
    train, valid = time_split(rows, date, validation)
    categories = [c for c in CATEGORIES if c in rows.columns]
    levels = hygiene.category_levels(train, categories) if categories else {}
    train, valid = hygiene.one_hot(train, levels), hygiene.one_hot(valid, levels)
    return train, valid, feature_columns(train, target, key, date, levels)


def _boosted(train: DataFrame, features: Sequence[str], target: str, params: dict) -> GBTRegressionModel:
    data = assemble(train.select(*features, F.col(target).cast("double").alias("label")), features)
    return fit_trees(data.select("features", "label"), **params)


def _predict_boosted(model: GBTRegressionModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    out = model.transform(assemble(df, features)).drop("features")
    return out.withColumn("prediction", F.greatest(F.lit(0.0), "prediction"))


def long_predictions(
    models: dict[str, RidgeModel | GBTRegressionModel], df: DataFrame, features: Sequence[str], target: str, keep: Sequence[str]
) -> DataFrame:
    """(keep, y, model, prediction); predictions are not negative."""
    frames = None
    for name, model in models.items():
        predicted = (
            model.predict(df, floor=0.0) if isinstance(model, RidgeModel) else _predict_boosted(model, df, features)
        )
        part = predicted.select(*keep, F.col(target).cast("double").alias("y"), F.lit(name).alias("model"), "prediction")
        frames = part if frames is None else frames.unionByName(part)
    return frames


def train_panel(
    panel: DataFrame,
    labels: DataFrame | None = None,
    key: str = "store_id",
    date: str = "date",
    target: str = "units_sold",
    validation: float = 0.20,
    boosted: dict | None = None,
) -> TrainedPanel:
    """Ridge and boosted trees on the same fold; metrics on validation rows that are not labelled anomalous."""
    train, valid, features = training_folds(panel, key, date, target, validation)
    if labels is not None:
        valid = metrics.exclude_anomalies(valid, labels)
    models = {
        "ridge": pooled_ridge(train, features, target, [RIDGE_ALPHA])[RIDGE_ALPHA],
        "boosted": _boosted(train, features, target, {**BOOSTED, **(boosted or {})}),
    }
    keep = [key, date, *([c for c in ("row_index",) if c in valid.columns])]
    long = long_predictions(models, valid, features, target, keep)
    return TrainedPanel(models, features, long, metrics.demand_metrics(long, "y", "prediction", ["model"]))


def gates(model_metrics: DataFrame) -> DataFrame:
    """Hard gates of the boosted model: RMSPE at most 15 %, R2 at least 0.85, RMSPE under ridge's."""
    ridge = F.max(F.when(F.col("model") == "ridge", F.col("rmspe")))
    own = {c: F.max(F.when(F.col("model") == "boosted", F.col(c))).alias(c) for c in ("rmspe", "r2")}
    return model_metrics.agg(own["rmspe"], own["r2"], ridge.alias("ridge_rmspe")).select(
        "*",
        (F.col("rmspe") <= RMSPE_GATE).alias("rmspe_ok"),
        (F.col("r2") >= R2_GATE).alias("r2_ok"),
        (F.col("rmspe") < F.col("ridge_rmspe")).alias("beats_ridge"),
    ).withColumn("passes", F.col("rmspe_ok") & F.col("r2_ok") & F.col("beats_ridge"))


def ridge_grid(
    train: DataFrame, valid: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float] = RIDGE_GRID
) -> DataFrame:
    """Validation metrics per penalty, best R2 first. All penalties share one pass over the training rows
    and one over the validation rows."""
    models = pooled_ridge(train, features, target, alphas)
    wide = valid.select(*features, F.col(target).cast("double").alias("y"))
    for i, a in enumerate(alphas):
        wide = models[a].predict(wide, f"p{i}", floor=0.0)
    entries = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"p{i}").alias("prediction")) for i, a in enumerate(alphas)])
    long = wide.select("y", F.inline(entries))
    return metrics.demand_metrics(long, "y", "prediction", ["alpha"]).orderBy(F.desc("r2"))


def tree_grid(
    train: DataFrame, valid: DataFrame, features: Sequence[str], target: str, grid: dict[str, Sequence] | None = None, pool: int = 4
) -> DataFrame:
    """Validation metrics per boosted configuration, best R2 first; the fold is fixed.

    Boosting adds trees one by one, so the model of the most rounds holds those of all others: configurations that differ in
    ``maxIter`` alone share one fit, and one pass over the validation rows gives the predictions of every stage. Up to ``pool`` fits
    share the cluster at a time.
    """
    grid = grid or TREE_GRID
    stages = sorted(grid.get("maxIter", (20,)))
    others = {k: v for k, v in grid.items() if k != "maxIter"}
    data = assemble(train.select(*features, F.col(target).cast("double").alias("label")), features).select("features", "label").persist()
    check = valid.select(*features, F.col(target).cast("double").alias("y")).persist()
    spark = train.sparkSession

    def judge(values: tuple) -> list[tuple]:
        params = dict(zip(others, values))
        ensemble = from_boosted(fit_trees(data, seed=42, maxIter=stages[-1], **params), spark)
        staged = predict_staged(check, ensemble, features, stages, ["y"])
        long = staged.select("y", F.posexplode("stages").alias("stage", "prediction")).withColumn("prediction", F.greatest(F.lit(0.0), "prediction"))
        found = metrics.demand_metrics(long, "y", "prediction", ["stage"]).collect()
        return [(*[float({**params, "maxIter": stages[m["stage"]]}[k]) for k in names[:-4]], m["rmspe"], m["mae"], m["rmse"], m["r2"]) for m in found]

    names = [*others, "maxIter", "rmspe", "mae", "rmse", "r2"]
    with ThreadPool(pool) as threads:
        rows = [r for part in threads.map(inheritable_thread_target(spark)(judge), list(product(*others.values()))) for r in part]
    data.unpersist()
    check.unpersist()
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).orderBy(F.desc("r2"))


def scaled_fold(train: DataFrame, valid: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both folds standardised with the mean and population sd of the training fold."""
    facts = column_facts(train, features)
    return standardise(train, facts), standardise(valid, facts)
