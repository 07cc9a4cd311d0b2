"""Forecast and detector metrics, each one aggregation pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.order_stats import exact_quantiles
from millrace.operators.roles import correlation

MIN_DEMAND = 50.0


def regression_columns(actual: Column, predicted: Column) -> list[Column]:
    """RMSPE over non-zero actuals (a fraction), MAE, RMSE, R2, n and the zero actuals left out."""
    error = actual - predicted
    share = F.when(actual != 0, F.pow(error / F.when(actual != 0, actual), 2))
    spread = F.var_pop(actual) * F.count(error)
    return [
        F.sqrt(F.avg(share)).alias("rmspe"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(error * error), spread)).alias("r2"),
        F.count(error).alias("n"),
        F.count_if(actual == 0).alias("n_zero_actuals"),
    ]


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*regression_columns(F.col(actual).cast("double"), F.col(predicted).cast("double")))


def demand_rmspe(actual: Column, predicted: Column, least: float = MIN_DEMAND) -> Column:
    """RMSPE in percent over actuals of at least ``least``; 0 when there are none."""
    error = F.when(actual >= least, (actual - predicted) / actual)
    return F.coalesce(F.sqrt(F.avg(error * error)) * 100, F.lit(0.0))


def demand_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSPE over actuals >= 50 (percent), MAE, RMSE, R2 per group."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    keep = {"mae", "rmse", "r2", "n"}
    rest = [c for c, n in zip(regression_columns(y, p), ("rmspe", "mae", "rmse", "r2", "n", "z")) if n in keep]
    return df.groupBy(*by).agg(demand_rmspe(y, p).alias("rmspe"), *rest)


def sliced_metrics(long: DataFrame, actual: str = "y", predicted: str = "prediction", by: Sequence[str] = ("model",)) -> DataFrame:
    """Error metrics below and from 50 units, per model, over long predictions."""
    side = F.when(F.col(actual) < MIN_DEMAND, "y < 50").otherwise("y >= 50").alias("slice")
    return demand_metrics(long.select("*", side), actual, predicted, [*by, "slice"])


def skill(model_rmse: Column, naive_rmse: Column) -> Column:
    """1 - rmse / naive rmse; NULL when the naive error is missing or zero."""
    return F.lit(1.0) - F.try_divide(model_rmse, naive_rmse)


def confusion(df: DataFrame, truth: str, flagged: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts with precision, recall and F1 (0 when undefined)."""
    t, f = F.col(truth).cast("boolean"), F.col(flagged).cast("boolean")
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return (
        df.groupBy(*by)
        .agg(
            F.count_if(t & f).alias("true_positives"),
            F.count_if(~t & f).alias("false_positives"),
            F.count_if(t & ~f).alias("false_negatives"),
            F.count_if(~t & ~f).alias("true_negatives"),
        )
        .select(
            "*",
            F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
            F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
            F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        )
    )


def detector_gate(evaluated: DataFrame) -> DataFrame:
    """Recall at least 0.90 and (precision at least 0.80 or F1 at least 0.85)."""
    good = (F.col("recall") >= 0.90) & ((F.col("precision") >= 0.80) | (F.col("f1") >= 0.85))
    return evaluated.withColumn("passes", good)


def top_share_recall(df: DataFrame, truth: str, score: str, share: float = 0.05) -> float:
    """Recall of the truth among scores at or above the (1 - share) quantile (exact)."""
    cut = exact_quantiles(df, F.col(score), [1 - share])[()][0]
    r = df.where(F.col(truth).cast("boolean")).agg(F.avg((F.col(score) >= cut).cast("double"))).first()
    return r[0]


def curve_areas(df: DataFrame, truth: str, score: str) -> dict[str, float]:
    """Areas under the ROC and precision-recall curves."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    data = df.select(F.col(truth).cast("double").alias("label"), F.col(score).cast("double").alias("score"))
    measure = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score", numBins=0)
    return {
        "roc_auc": measure.evaluate(data, {measure.metricName: "areaUnderROC"}),
        "pr_auc": measure.evaluate(data, {measure.metricName: "areaUnderPR"}),
    }


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Min, 5/25/50/75/95 % points, mean, sd, max, the share below 50 and a low-magnitude flag."""
    y = F.col(target).cast("double")
    points = exact_quantiles(df, y, [0.05, 0.25, 0.5, 0.75, 0.95]).get((), [None] * 5)
    marks = {n: F.lit(v).cast("double").alias(n) for n, v in zip(("p5", "p25", "median", "p75", "p95"), points)}
    return df.agg(
        F.count(y).alias("n"), F.min(y).alias("min"), F.max(y).alias("max"), F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("sd"), F.avg((y < MIN_DEMAND).cast("double")).alias("share_below_50"),
    ).select("*", *marks.values()).withColumn(
        "low_magnitude", (F.col("median") < 10) | (F.col("sd") > F.col("median"))
    )


def correlation_ranking(df: DataFrame, target: str, features: Sequence[str], weak: float = 0.1) -> DataFrame:
    """Pearson r of each feature with the target, strongest first, and whether all are weak."""
    y = F.col(target).cast("double")
    row = df.agg(*[correlation(F.col(c).cast("double"), y).alias(f"r{i}") for i, c in enumerate(features)])
    listed = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r")) for i, c in enumerate(features)])
    strongest = F.array_max(F.transform(listed["r"], F.abs))
    return row.select(
        F.inline(listed), F.coalesce(strongest < weak, F.lit(True)).alias("all_weak")
    ).orderBy(F.desc_nulls_last(F.abs("r")), "feature")


def exclude_anomalies(rows: DataFrame, labels: DataFrame, key: str = "row_index", flag: str = "is_anomaly") -> DataFrame:
    """Drop the rows labelled anomalous; a row without label is clean. Spark broadcasts a small label side."""
    return rows.join(labels.where(F.col(flag).cast("boolean")).select(key), key, "left_anti")


def low_demand_detail(long: DataFrame, least: float = MIN_DEMAND) -> DataFrame:
    """Each prediction for an actual below ``least`` with its error and absolute percentage error."""
    error = F.col("prediction") - F.col("y")
    return long.where(F.col("y") < least).select(
        "*", error.alias("error"), (F.abs(error) / F.nullif(F.col("y"), F.lit(0.0)) * 100).alias("error_pct")
    )


