"""Smoothed mean encodings of a category: leak-free while training, a lookup afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMOOTHING = 10.0


def expanding_encoding(
    target: Column, category: Column, keys: Sequence[str], period: str, smoothing: float = SMOOTHING
) -> Column:
    """Past mean of the own category, pulled toward the past mean of the series by ``smoothing`` rows.

    Rows where ``target`` is NULL neither count nor contribute, so a training mask is a NULL target.
    """
    own = Window.partitionBy(*keys, category).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    series = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    past_mean = F.coalesce(F.avg(target).over(series), F.lit(0.0))
    return (F.coalesce(F.sum(target).over(own), F.lit(0.0)) + past_mean * smoothing) / (
        F.count(target).over(own) + F.lit(smoothing)
    )


def fold_encoding(target: Column, category: Column, keys: Sequence[str], smoothing: float = SMOOTHING) -> Column:
    """Lookup value of the whole training fold (rows with a non-NULL target), as a window expression."""
    own, series = Window.partitionBy(*keys, category), Window.partitionBy(*keys)
    mean = F.avg(target).over(series)
    return (F.coalesce(F.sum(target).over(own), F.lit(0.0)) + mean * smoothing) / (
        F.count(target).over(own) + F.lit(smoothing)
    )


def encoding_table(
    df: DataFrame, target: str, category: str, keys: Sequence[str] = (), smoothing: float = SMOOTHING
) -> DataFrame:
    """(keys, category, encoding, default): the smoothed mean per category and the overall mean.

    Rows are combined per category first; the overall mean comes from those few rows.
    """
    per_category = df.groupBy(*keys, category).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    if keys:
        series = Window.partitionBy(*keys)
        mean = F.sum("_s").over(series) / F.sum("_n").over(series)
    else:  # one partial aggregate of the rows; a window would bring all categories into one task
        mean = df.agg((F.sum(target) / F.count(target)).alias("mean")).scalar()
    return per_category.select(
        *keys, category, ((F.col("_s") + mean * smoothing) / (F.col("_n") + smoothing)).alias("encoding"),
        mean.alias("default"),
    ).where(F.col(category).isNotNull())


def apply_encoding(
    df: DataFrame, table: DataFrame, category: str, output: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Look the encoding up; categories unseen in training get the overall mean of their series."""
    if keys:
        defaults = table.groupBy(*keys).agg(F.first("default").alias("_default"))
        joined = df.join(table.drop("default"), [*keys, category], "left").join(defaults, list(keys), "left")
    else:
        default = table.agg(F.max("default").alias("d")).scalar()
        joined = df.join(table.drop("default"), [category], "left").withColumn("_default", default)
    return joined.withColumn(output, F.coalesce("encoding", "_default")).drop("encoding", "_default")
