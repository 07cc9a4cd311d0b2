"""Chart-ready and report frames: histograms, box plots, scatter caps, outlier tables, bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.values import quoted, rounded
from millrace.operators.clusters import draw_order

# Names that may hold a record's id, in order of preference.
RECORD_ID_NAMES = ("id", "ID", "CustomerID", "customer_id", "client_id", "index")
MAX_RECORDS = 100
MAX_POINTS = 10_000
SHOWN_PERIODS = 365


def record_id(df: DataFrame, fallback: str | None = None, keys: Sequence[str] = ()) -> Column:
    """Id of a record as text: the caller's keys joined by a dash, else a column named like an id, else a digest of the row."""
    if keys:
        return F.concat_ws("-", *[quoted(k).cast("string") for k in keys])
    names = [n for n in RECORD_ID_NAMES if n in df.columns] + ([fallback] if fallback else [])
    row = F.hex(F.xxhash64(*[quoted(c) for c in df.columns]))
    return F.coalesce(*[quoted(n).cast("string") for n in names], row)


def top_outliers(
    scored: DataFrame, score: str = "anomaly_score", n: int = MAX_RECORDS, fallback_id: str | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """The report's n strangest rows with their original columns; a top-k, not a sort of all rows."""
    first = record_id(scored.drop(score), fallback_id, keys).alias("record_id")
    rest = [c for c in scored.columns if c != score]
    return (
        scored.select(first, rounded(F.col(score)).alias(score), F.col(score).alias("_exact"), *[quoted(c) for c in rest])
        .orderBy(F.desc("_exact"), "record_id")
        .limit(n)
        .drop("_exact")
    )


def scatter_points(
    df: DataFrame, outlier: str = "is_outlier", cap: int = MAX_POINTS, id_col: str | None = None, seed: int = 42
) -> DataFrame:
    """Every outlier, filled up to ``cap`` rows with randomly drawn inliers.

    Only the number of outliers reaches the driver. The drawn inliers are a top-k by hash.
    """
    marked = F.col(outlier)
    outliers = df.where(marked)
    room = max(0, cap - outliers.count())
    inliers = df.where(~marked)
    if not room:
        return outliers
    drawn = inliers.withColumn("_draw", draw_order(df, id_col, seed)).orderBy("_draw").limit(room).drop("_draw")
    return outliers.unionByName(drawn)


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, lower, upper, count) with equal widths; the upper edge belongs to the last bin.

    Values outside a given range are not counted. Bounds come from one min/max pass when not given.
    """
    value = quoted(column).cast("double")
    if low is None or high is None:
        r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        low, high = r["lo"] if low is None else low, r["hi"] if high is None else high
    width = (high - low) / bins or 1.0
    place = F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / width).cast("int"))
    counted = (
        df.select(value.alias("v")).where(F.col("v").between(low, high))
        .groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    )
    return counted.select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("lower"), (F.lit(low) + (F.col("bin") + 1) * width).alias("upper"), "count"
    )


def error_bars(stats: DataFrame) -> DataFrame:
    """Group mean with mean - sd and mean + sd."""
    return stats.select("*", (F.col("mean") - F.col("std")).alias("low"), (F.col("mean") + F.col("std")).alias("high"))


def box_plot(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stats.select(*keys, "min", "q1", "median", "q3", "max")


def recent(df: DataFrame, keys: Sequence[str] = (), period: str = "period", n: int = SHOWN_PERIODS) -> DataFrame:
    """The last n periods of each series."""
    back = Window.partitionBy(*keys).orderBy(F.desc(period))
    return df.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n).drop("_back")


def forecast_band_rows(
    history: DataFrame, forecast: DataFrame, target: str, keys: Sequence[str] = (), period: str = "period"
) -> DataFrame:
    """Actual, forecast, lower and upper in one long frame by date."""
    past = history.select(*keys, period, F.col(target).cast("double").alias("actual"))
    ahead = forecast.select(*keys, period, "forecast", "lower", "upper")
    return past.unionByName(ahead, allowMissingColumns=True)
