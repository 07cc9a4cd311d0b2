"""Leak-free look-back features: every value at t is made of rows before t."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.calendar import panel_calendar, series_calendar, series_calendar_names

# Look-backs of the store panel.
PANEL_LAGS = (7, 14, 21, 30)
PANEL_WINDOWS = (7, 14, 30)


def feature_names(code: str, lags: Sequence[int], windows: Sequence[int], inputs: Sequence[str] = ()) -> list[str]:
    names = series_calendar_names(code) + [f"lag_{n}" for n in lags]
    names += [f"roll{w}_{s}" for w in windows for s in ("mean", "std", "min", "max")]
    return names + [f"x_{c}_lag1" for c in inputs]


def series_features(
    df: DataFrame,
    target: str,
    code: str,
    lags: Sequence[int],
    windows: Sequence[int],
    inputs: Sequence[str] = (),
    keys: Sequence[str] = (),
    period: str = "period",
) -> DataFrame:
    """Calendar, lag and rolling features on a dense grid; one exchange, one sort, one projection.

    A rolling window of w ends min(lags) periods back and is NULL until it is full.
    """
    order = Window.partitionBy(*keys).orderBy(period)
    y, nearest = F.col(target), min(lags)
    columns: list[Column] = [*series_calendar(F.col(period), code)]
    columns += [F.lag(y, n).over(order).alias(f"lag_{n}") for n in lags]
    for w in windows:
        frame = order.rowsBetween(-(nearest + w - 1), -nearest)
        full = F.count(y).over(frame) == w
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            columns.append(F.when(full, f(y).over(frame)).alias(f"roll{w}_{name}"))
    columns += [F.lag(c, 1).over(order).alias(f"x_{c}_lag1") for c in inputs]
    return df.select("*", *columns)


def panel_features(
    df: DataFrame, key: str = "store_id", date: str = "date", target: str = "units_sold", drop_incomplete: bool = True
) -> DataFrame:
    """Features of a panel with one row per (key, date), by row position within the key.

    Lags 7/14/21/30 and rolling mean and sd over the 7/14/30 rows strictly before; a window of one
    row has sd 0. Rows with any NULL are dropped, which removes the look-back head of each key.
    The keys' partitions are bounded by the number of dates.
    """
    order = Window.partitionBy(key).orderBy(date)
    y = F.col(target)
    columns = [F.lag(y, n).over(order).alias(f"lag_{n}") for n in PANEL_LAGS]
    for w in PANEL_WINDOWS:
        frame = order.rowsBetween(-w, -1)
        columns.append(F.avg(y).over(frame).alias(f"rolling_mean_{w}"))
        columns.append(F.coalesce(F.stddev_samp(y).over(frame), F.lit(0.0)).alias(f"rolling_std_{w}"))
    calendar = panel_calendar(F.col(date))
    replaced = {"day_of_week", "day_of_month", "month", "day_of_year", "is_weekend"}
    own = [c for c in df.columns if c not in replaced]
    out = df.select(*own, *columns, *calendar)
    return out.dropna("any") if drop_incomplete else out
