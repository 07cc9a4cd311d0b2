"""Calendar parts and cyclic encodings of a date column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TURN = 2 * math.pi


def _wave(position: Column, length: float, sin_name: str, cos_name: str) -> list[Column]:
    angle = F.lit(_TURN) * position / F.lit(float(length))
    return [F.sin(angle).alias(sin_name), F.cos(angle).alias(cos_name)]


def series_calendar(period: Column, code: str) -> list[Column]:
    """Calendar features of a period start. Daily series get all, weekly the ISO week too."""
    month = F.month(period)
    parts = [month.alias("month"), F.quarter(period).alias("quarter")]
    parts += _wave(month - 1, 12, "month_sin", "month_cos")
    if code == "D":
        dow = F.weekday(period)  # Monday is 0
        parts += [
            dow.alias("dow"),
            F.dayofmonth(period).alias("dom"),
            F.weekofyear(period).alias("weekofyear"),
            (dow >= 5).cast("int").alias("is_weekend"),
        ]
        parts += _wave(dow, 7, "dow_sin", "dow_cos")
    elif code == "W":
        parts.append(F.weekofyear(period).alias("weekofyear"))
    return parts


def series_calendar_names(code: str) -> list[str]:
    names = ["month", "quarter", "month_sin", "month_cos"]
    if code == "D":
        names += ["dow", "dom", "weekofyear", "is_weekend", "dow_sin", "dow_cos"]
    elif code == "W":
        names.append("weekofyear")
    return names


def panel_calendar(date: Column) -> list[Column]:
    """Calendar features of the store panel; the month phase starts at 1 here, not at 0."""
    dow, month, doy = F.weekday(date), F.month(date), F.dayofyear(date)
    parts = [
        dow.alias("day_of_week"),
        F.dayofmonth(date).alias("day_of_month"),
        month.alias("month"),
        doy.alias("day_of_year"),
        (dow >= 5).cast("int").alias("is_weekend"),
    ]
    parts += _wave(dow, 7, "sin_dow", "cos_dow")
    parts += _wave(month, 12, "sin_month", "cos_month")
    parts += _wave(doy, 365.25, "sin_doy", "cos_doy")
    return parts
