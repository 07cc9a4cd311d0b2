"""Regular period grids: resampling, gap filling, interpolation.

Everything after the group-by runs on one row per (series, period), so a window partition is bounded
by the calendar. All windows share one exchange on the series keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.cadence import period_number, period_start, shift_period


def resample(
    df: DataFrame,
    date: str,
    code: str,
    target: str,
    how: str = "sum",
    averaged: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    """(keys, period, target, averaged columns, rows) with the target summed or averaged per period."""
    combine = {"sum": F.sum, "mean": F.avg}[how]
    usable = df.where(F.col(date).isNotNull() & F.col(target).isNotNull())
    return usable.groupBy(*keys, period_start(F.col(date), code).alias("period")).agg(
        combine(F.col(target).cast("double")).alias(target),
        *[F.avg(F.col(c).cast("double")).alias(c) for c in averaged],
        F.count(F.lit(1)).alias("rows"),
    )


def dense_grid(df: DataFrame, code: str, keys: Sequence[str] = (), period: str = "period") -> DataFrame:
    """Add the missing periods of each series with NULL values and ``is_gap`` set.

    Each row is repeated up to the next one of its series, so no calendar has to be joined back.
    """
    order = Window.partitionBy(*keys).orderBy(period)
    others = [c for c in df.columns if c not in (*keys, period)]
    span = F.coalesce(period_number(F.lead(period).over(order), code) - period_number(F.col(period), code), F.lit(1))
    steps = df.withColumn("_span", span).withColumn("_step", F.explode(F.sequence(F.lit(0), F.col("_span") - 1)))
    own = F.col("_step") == 0
    return steps.select(
        *keys,
        shift_period(F.col(period), F.col("_step"), code).alias(period),
        *[F.when(own, F.col(c)).alias(c) for c in others],
        (~own).alias("is_gap"),
    )


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.coalesce(c, F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def interpolate_linear(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), period: str = "period"
) -> DataFrame:
    """Linear fill by row position within each series; both edges are held.

    The look-ahead is a running window in descending order, which costs a sort but stays linear.
    """
    order = Window.partitionBy(*keys).orderBy(period)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    from_end = Window.partitionBy(*keys).orderBy(F.desc(period)).rowsBetween(Window.unboundedPreceding, 0)
    placed = df.withColumn("_at", F.row_number().over(order))

    def known(column: str, frame) -> tuple[Column, Column]:
        here = F.when(F.col(column).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(column).alias("v")))
        found = F.last(here, ignorenulls=True).over(frame)
        return found["at"], found["v"]

    ends = placed
    for column in columns:
        (before_at, before), (after_at, after) = known(column, so_far), known(column, from_end)
        ends = ends.withColumns({
            f"_{column}_b": before, f"_{column}_bat": before_at, f"_{column}_a": after, f"_{column}_aat": after_at,
        })

    def filled(column: str) -> Column:
        b, a = F.col(f"_{column}_b"), F.col(f"_{column}_a")
        part = (F.col("_at") - F.col(f"_{column}_bat")) / (F.col(f"_{column}_aat") - F.col(f"_{column}_bat"))
        between = F.when(F.col(f"_{column}_aat") > F.col(f"_{column}_bat"), b + (a - b) * part)
        return F.coalesce(F.col(column), between, b, a).alias(column)

    return ends.select(*[filled(c) if c in columns else F.col(c) for c in df.columns])


def carry_last(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), period: str = "period") -> DataFrame:
    """Last known value carried forward, leading gaps back-filled, then 0 (future values of inputs)."""
    so_far = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    from_end = Window.partitionBy(*keys).orderBy(F.desc(period)).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*[
        F.coalesce(
            F.last(c, ignorenulls=True).over(so_far), F.last(c, ignorenulls=True).over(from_end), F.lit(0.0)
        ).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])


def future_periods(last: DataFrame, code: str, horizon: int, period: str = "period") -> DataFrame:
    """The next ``horizon`` period starts after each series' last one, numbered by ``step``."""
    return last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        period, shift_period(F.col(period), F.col("step"), code)
    )
