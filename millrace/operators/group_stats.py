"""Per-group statistics and the test statistics built from them (nothing here gathers a group)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.values import clean_number, is_number, quoted, whole_label
from millrace.operators.order_stats import value_positions

# A group of fewer rows has no usable variance.
MIN_GROUP_ROWS = 5


def long_groups(df: DataFrame, target: str, group_cols: Sequence[str]) -> DataFrame:
    """One row per (row, grouping column): grouping_column, level, level_number, y. NULLs dropped.

    The fan-out happens inside the scan stage; the group-by that follows combines it map-side.
    """
    fields = {f.name: f for f in df.schema.fields}
    y = clean_number(fields[target]) if is_number(fields[target]) else quoted(target).try_cast("double")
    entries = []
    for name in group_cols:
        f = fields[name]
        col = clean_number(f) if is_number(f) else quoted(name)
        entries.append(
            F.struct(
                F.lit(name).alias("grouping_column"),
                whole_label(col, f).alias("level"),
                (col.cast("double") if is_number(f) else F.lit(None).cast("double")).alias("level_number"),
            )
        )
    return (
        df.select(y.cast("double").alias("y"), F.inline(F.array(*entries)))
        .where("y IS NOT NULL AND level IS NOT NULL")
        .select("grouping_column", "level", "level_number", "y")
    )


def level_moments(long: DataFrame, by: Sequence[str] = ("grouping_column", "level", "level_number")) -> DataFrame:
    """n, mean, sample variance, third central moment, min and max per level, in one pass."""
    n, var = F.col("n"), F.col("variance")
    population = F.coalesce(var, F.lit(0.0)) * (n - 1) / n
    return (
        long.groupBy(*by)
        .agg(
            F.count("y").alias("n"),
            F.avg("y").alias("mean"),
            F.var_samp("y").alias("variance"),
            F.skewness("y").alias("_g1"),
            F.min("y").alias("min"),
            F.max("y").alias("max"),
        )
        .withColumn("third_moment", F.when(population > 0, F.col("_g1") * F.pow(population, 1.5) * n).otherwise(0.0))
        .drop("_g1")
    )


def usable_levels(moments: DataFrame, least_rows: int = MIN_GROUP_ROWS, most_groups: int | None = None) -> DataFrame:
    """Levels with at least ``least_rows`` rows; all of them, or the ``most_groups`` largest per grouping column."""
    if most_groups is None:
        return moments.where(F.col("n") >= least_rows)
    largest = Window.partitionBy("grouping_column").orderBy(F.desc("n"), "level_number", "level")
    return (
        moments.where(F.col("n") >= least_rows)
        .withColumn("_place", F.row_number().over(largest))
        .where(F.col("_place") <= most_groups)
        .drop("_place")
    )


def pooled_by(key: str, levels: DataFrame) -> DataFrame:
    """Sums over the levels of each grouping column: N, grand mean, SSB, SSW and the pooled skewness."""
    grand = levels.groupBy(key).agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("n_groups"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand_mean"),
        F.max(F.coalesce("variance", F.lit(0.0))).alias("largest_variance"),
    )
    gap = F.col("mean") - F.col("grand_mean")
    m2 = F.coalesce("variance", F.lit(0.0)) * (F.col("n") - 1)
    sums = (
        levels.join(grand, key)
        .groupBy(key, "total", "n_groups", "grand_mean", "largest_variance")
        .agg(
            F.sum(F.col("n") * gap * gap).alias("ssb"),
            F.sum(m2).alias("ssw"),
            F.sum(F.col("third_moment") + 3 * gap * m2 + F.col("n") * gap * gap * gap).alias("_m3"),
        )
    )
    population = (F.col("ssb") + F.col("ssw")) / F.col("total")
    skew = F.when(population > 0, F.col("_m3") / F.col("total") / F.pow(population, 1.5))
    return sums.withColumn("skew", skew).drop("_m3")


def anova(pooled: DataFrame) -> DataFrame:
    """One-way ANOVA: F, degrees of freedom and eta squared. NULL where undefined."""
    k, n = F.col("n_groups"), F.col("total")
    between, within = F.try_divide(F.col("ssb"), k - 1), F.try_divide(F.col("ssw"), n - k)
    return pooled.select(
        "*",
        F.try_divide(between, within).alias("f_statistic"),
        (k - 1).alias("df_between"),
        (n - k).alias("df_within"),
        F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta_squared"),
    )


def welch(pairs: DataFrame) -> DataFrame:
    """Welch t of ``b`` against baseline ``a``; needs n_a, mean_a, variance_a and the same for b.

    The sign of t follows the baseline minus the comparison, the difference the other way round.
    """
    va, vb = F.col("variance_a") / F.col("n_a"), F.col("variance_b") / F.col("n_b")
    pooled_sd = F.sqrt((F.col("variance_a") + F.col("variance_b")) / 2)
    return pairs.select(
        "*",
        F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(va + vb)).alias("t_statistic"),
        F.try_divide(
            (va + vb) * (va + vb), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1)
        ).alias("df"),
        (F.col("mean_b") - F.col("mean_a")).alias("mean_difference"),
        F.try_divide(F.col("mean_b") - F.col("mean_a"), pooled_sd).alias("cohens_d"),
    )


def first_two_levels(levels: DataFrame) -> DataFrame:
    """Baseline (first in sort order) and comparison side by side, for grouping columns with two levels."""
    order = Window.partitionBy("grouping_column").orderBy("level_number", "level")
    both = Window.partitionBy("grouping_column")
    numbered = levels.withColumn("_at", F.row_number().over(order)).withColumn("_of", F.count(F.lit(1)).over(both))

    def pick(name: str, at: int) -> Column:
        return F.max(F.when(F.col("_at") == at, F.col(name)))

    return (
        numbered.where("_of = 2")
        .groupBy("grouping_column")
        .agg(
            *[
                pick(name, at).alias(f"{name}_{side}")
                for at, side in ((1, "a"), (2, "b"))
                for name in ("level", "n", "mean", "variance")
            ]
        )
    )


def value_counts(long: DataFrame, levels: DataFrame) -> DataFrame:
    """Rows (``copies``) of each value per level, of the (grouping_column, level) pairs that ``levels`` names."""
    keep = F.broadcast(levels.select("grouping_column", "level"))
    return (
        long.join(keep, ["grouping_column", "level"], "left_semi")
        .groupBy("grouping_column", "level", "y")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def rank_sums(long: DataFrame, levels: DataFrame, rows: int) -> DataFrame:
    """Mid-rank sum per level and the tie term per grouping column, exact on all rows.

    ``levels`` names the (grouping_column, level) pairs to keep, at most twelve per column.
    """
    return counted_rank_sums(value_counts(long, levels), rows)


def counted_rank_sums(counts: DataFrame, rows: int) -> DataFrame:
    """:func:`rank_sums` of the rows of each value (:func:`value_counts`)."""
    # A value carries the counts of its levels (twelve at most), so ranks need not be joined back.
    held = {"levels": F.collect_list(F.struct("level", "copies"))}
    spots = value_positions(counts, ["grouping_column"], "y", "copies", rows, held)
    mid = F.col("below") + (F.col("tied") + 1) / F.lit(2.0)
    tied = F.col("tied").cast("double")
    per_level = spots.select(
        "grouping_column", mid.alias("mid"), (tied * tied * tied - tied).alias("tie"), F.posexplode("levels").alias("place", "held")
    )
    copies = F.col("held.copies")
    sums = per_level.groupBy("grouping_column", F.col("held.level").alias("level")).agg(
        F.sum(copies).alias("n"),
        F.sum(copies * F.col("mid")).alias("rank_sum"),
        # The tie of a value counts once, with the first level that holds it.
        F.sum(F.when(F.col("place") == 0, F.col("tie")).otherwise(0.0)).alias("_tie"),
    )
    whole = Window.partitionBy("grouping_column")
    return sums.withColumn("tie_term", F.sum("_tie").over(whole)).drop("_tie")


def holm(pvalues: DataFrame, p: str = "p_value") -> DataFrame:
    """Holm step-down over the rows of a small frame (one row per test)."""
    rising = Window.orderBy(p)
    everything = Window.partitionBy()
    step = (F.count(p).over(everything) - F.row_number().over(rising) + 1) * F.col(p)
    return pvalues.withColumn("_step", F.least(F.lit(1.0), step)).withColumn(
        "p_value_adjusted", F.max("_step").over(rising.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_step")
