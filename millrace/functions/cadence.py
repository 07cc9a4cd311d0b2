"""Reporting periods: the four supported cadences and the arithmetic on their period starts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cadence:
    code: str
    title: str
    lags: tuple[int, ...]
    windows: tuple[int, ...]
    season: int
    max_holdout: int
    default_horizon: int
    max_horizon: int


# Look-backs, seasons, holdouts and horizons per cadence.
CADENCES: dict[str, Cadence] = {
    "D": Cadence("D", "daily", (1, 7, 14, 21, 28), (7, 30), 7, 42, 14, 90),
    "W": Cadence("W", "weekly", (1, 2, 4, 8, 52), (4, 12), 52, 8, 8, 26),
    "M": Cadence("M", "monthly", (1, 2, 3, 6, 12), (3, 6), 12, 12, 12, 24),
    "Q": Cadence("Q", "quarterly", (1, 2, 4), (2, 4), 4, 4, 4, 8),
}

_TRUNC_UNIT = {"W": "week", "M": "month", "Q": "quarter"}
_MIN_TRAINING_PERIODS = 20


def period_start(when: Column, code: str) -> Column:
    """First day of the period holding ``when`` (weeks start on Monday)."""
    day = when.cast("date")
    return day if code == "D" else F.trunc(day, _TRUNC_UNIT[code])


def shift_period(start: Column, steps: Column | int, code: str) -> Column:
    """Period start moved by whole periods."""
    steps = F.lit(steps) if isinstance(steps, int) else steps
    steps = steps.cast("int")
    if code == "D":
        return F.date_add(start, steps)
    if code == "W":
        return F.date_add(start, steps * F.lit(7))
    return F.add_months(start, steps if code == "M" else steps * F.lit(3))


def period_number(start: Column, code: str) -> Column:
    """Consecutive integer of a period start; neighbours differ by one."""
    if code == "D":
        return F.unix_date(start)
    if code == "W":
        # 1970-01-05 was a Monday.
        return F.floor((F.unix_date(start) - F.lit(4)) / F.lit(7)).cast("int")
    if code == "M":
        return F.year(start) * 12 + F.month(start) - 1
    return F.year(start) * 4 + F.quarter(start) - 1


@dataclass(frozen=True)
class LookBack:
    """What a series of a given length can support."""

    lags: tuple[int, ...]
    windows: tuple[int, ...]
    holdout: int


class TooShort(ValueError):
    """The series cannot feed even the smallest look-back."""


def choose_look_back(code: str, periods: int) -> LookBack:
    """Longest look-back that still leaves 20 periods to train on beside head and holdout."""
    cadence = CADENCES[code]
    windows = tuple(w for w in cadence.windows if w <= periods // 4)
    holdout = min(cadence.max_holdout, max(3, periods // 4))
    needed = 0
    for kept in range(len(cadence.lags), 0, -1):
        lags = cadence.lags[:kept]
        head = max(lags[-1], lags[0] + max(windows, default=0))
        needed = head + holdout + _MIN_TRAINING_PERIODS
        if periods >= needed:
            return LookBack(lags, windows, holdout)
    raise TooShort(f"{periods} {cadence.title} periods given, at least {needed} needed for a forecast.")


def clamp_horizon(code: str, horizon: int | None) -> int:
    """The horizon asked for, or the cadence's own; raises for one that the cadence does not allow."""
    cadence = CADENCES[code]
    if horizon is not None and horizon > cadence.max_horizon:
        raise ValueError(f"{horizon} periods ahead asked for, at most {cadence.max_horizon} {cadence.title} periods are allowed")
    return max(horizon or cadence.default_horizon, 1)
