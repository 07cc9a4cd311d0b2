"""Numeric matrix operators: column facts, skew transform, standardisation, correlation, pooled ridge.

Facts of all columns come from one pass; products of columns are taken on standardised values, so
that large means do not cancel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import quoted, rounded

SKEW_LIMIT = 1.5
# Variance (of standardised values) under which a column counts as constant over the rows of a pair.
_LEAST_SPREAD = 1e-20


@dataclass(frozen=True)
class ColumnFacts:
    n: int
    mean: float | None
    sd_pop: float | None
    low: float | None
    skew: float | None  # bias-corrected (G1)

    @property
    def variance(self) -> float:
        return self.sd_pop**2 * self.n / (self.n - 1) if self.n > 1 else 0.0

    @property
    def scale(self) -> float:
        """Divisor of the standardisation; a constant column is only centred."""
        return self.sd_pop if self.sd_pop else 1.0


def column_facts(df: DataFrame, columns: Sequence[str]) -> dict[str, ColumnFacts]:
    """Count, mean, population sd, minimum and bias-corrected skewness of every column in one pass."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        v = quoted(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"),
                 F.min(v).alias(f"l{i}"), F.skewness(v).alias(f"g{i}")]
    r = df.agg(*aggs).first()
    facts = {}
    for i, c in enumerate(columns):
        n, g1 = r[f"n{i}"], r[f"g{i}"]
        skew = None
        if g1 is not None and not math.isnan(g1) and n > 2:
            skew = g1 * math.sqrt(n * (n - 1)) / (n - 2)
        facts[c] = ColumnFacts(n, r[f"m{i}"], r[f"s{i}"], r[f"l{i}"], skew)
    return facts


def skewness_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long (column_name, n, skew_population, skew_corrected) of every column; stays lazy."""
    aggs = []
    for i, c in enumerate(columns):
        v = quoted(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.skewness(v).alias(f"g{i}")]
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"g{i}").alias("skew_population"))
        for i, c in enumerate(columns)
    ])
    n, g = F.col("n").cast("double"), F.col("skew_population")
    corrected = F.when(n > 2, g * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))
    return df.agg(*aggs).select(F.inline(rows)).withColumn("skew_corrected", corrected)


def variance_table(df: DataFrame, columns: Sequence[str], least: float = 1e-12) -> DataFrame:
    """Columns by falling sample variance, without the constant ones."""
    row = df.agg(*[F.var_samp(quoted(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(columns)])
    return row.select(F.inline(rows)).where(F.col("variance") > least).orderBy(F.desc("variance"), "column_name")


def skewed_columns(facts: dict[str, ColumnFacts]) -> list[str]:
    """Columns to log-transform: skew over 1.5 and no value at or below -1."""
    return [c for c, f in facts.items() if f.skew is not None and f.skew > SKEW_LIMIT and f.low > -1]


def log_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[
        F.log1p(F.greatest(F.lit(0.0), quoted(c).cast("double"))).alias(c) if c in columns else quoted(c) for c in df.columns
    ])


def standardise(df: DataFrame, facts: dict[str, ColumnFacts]) -> DataFrame:
    """(x - mean) / population sd with facts that may come from other rows (the training fold)."""
    return df.select(*[
        ((quoted(c).cast("double") - facts[c].mean) / facts[c].scale).alias(c) if c in facts else quoted(c)
        for c in df.columns
    ])


@dataclass(frozen=True)
class PairMoments:
    """Sums over the rows in which both columns of a pair are present, of standardised values: number, value, square, product."""

    n: np.ndarray
    value: np.ndarray
    square: np.ndarray
    product: np.ndarray

    def correlations(self) -> np.ndarray:
        """Pearson correlations; NaN where a pair has no common row or a column does not vary over them."""
        n = np.where(self.n > 0, self.n, 1.0)
        spread = self.square - self.value**2 / n
        whole = (self.n > 0) & (spread > _LEAST_SPREAD * n) & (spread.T > _LEAST_SPREAD * n)
        shared = self.product - self.value * self.value.T / n
        return np.where(whole, shared / np.sqrt(np.where(whole, spread * spread.T, 1.0)), np.nan)


def pair_moments(df: DataFrame, columns: Sequence[str], facts: dict[str, ColumnFacts], copies: Column | None = None) -> PairMoments:
    """Moments of all column pairs in one scan, whatever their number.

    Each task multiplies its Arrow batches, with masks for missing values, to partial matrices; their rows are added up by column, so no
    task and not the driver holds more than one matrix of columns by columns. Values are standardised first, so large means don't cancel.
    A row stands for ``copies`` rows.
    """
    names, size = list(columns), len(columns)
    mean, scale = (np.array([x or 0.0 for x in xs]) for xs in ([facts[c].mean for c in names], [facts[c].scale for c in names]))
    weighed = copies is not None
    view = df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)], *([copies.cast("double").alias("copies")] if weighed else []))
    schema = "at int, n array<double>, value array<double>, square array<double>, product array<double>"
    parts = ("n", "value", "square", "product")

    def rows(sums: dict[int, list[np.ndarray]]):
        if sums:
            columns_ = [pa.array(list(sums), pa.int32())]
            columns_ += [pa.array([held[k] for held in sums.values()], pa.list_(pa.float64())) for k in range(len(parts))]
            yield pa.RecordBatch.from_arrays(columns_, names=["at", *parts])

    def multiply(batches):
        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            x, w = x[:, :size], x[:, size:] if weighed else 1.0
            here = ~np.isnan(x)
            z, mask = np.where(here, (x - mean) / scale, 0.0), here.astype(float)
            found = [mask.T @ (mask * w), z.T @ (mask * w), (z * z).T @ (mask * w), z.T @ (z * w)]
            total = found if total is None else [t + f for t, f in zip(total, found)]
        if total is not None:
            yield from rows({i: [t[i] for t in total] for i in range(size)})

    def add(batches):
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, i in enumerate(batch.column(0).to_pylist()):
                found = [batch.column(j + 1)[k].values.to_numpy() for j in range(len(parts))]
                sums[i] = [a + b for a, b in zip(sums[i], found)] if i in sums else found
        yield from rows(sums)

    held = view.mapInArrow(multiply, schema).repartition("at").mapInArrow(add, schema).collect()  # one row per column
    out = [np.zeros((size, size)) for _ in parts]
    for r in held:
        for k, part in enumerate(parts):
            out[k][r["at"]] = r[part]
    return PairMoments(*out)


def correlation_frame(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> tuple[DataFrame, bool]:
    """Long (x, y, value) Pearson matrix of all columns, or of the ``limit`` most variable ones; truncated?

    Pairs are compared over the rows where both are present; undefined correlations are 0. Two scans serve any number of columns.
    """
    facts = column_facts(df, columns)
    chosen = list(columns)
    truncated = limit is not None and len(chosen) > limit
    if truncated:
        chosen = sorted(columns, key=lambda c: (-facts[c].variance, columns.index(c)))[:limit]
    found = pair_moments(df, chosen, facts).correlations()
    found = np.where(np.isnan(found), 0.0, np.round(np.clip(found, -1.0, 1.0), 4)) + 0.0
    cells = [(a, b, float(found[i, j])) for i, a in enumerate(chosen) for j, b in enumerate(chosen)]
    return df.sparkSession.createDataFrame(cells, "x string, y string, value double"), truncated


@dataclass(frozen=True)
class RidgeModel:
    """Linear model on raw columns, the standardisation folded in."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def predict(self, df: DataFrame, output: str = "prediction", floor: float | None = None) -> DataFrame:
        value = F.lit(self.intercept)
        for name, weight in zip(self.features, self.coefficients):
            value = value + quoted(name).cast("double") * weight
        return df.withColumn(output, F.greatest(F.lit(floor), value) if floor is not None else value)


def pooled_ridge(
    df: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float]
) -> dict[float, RidgeModel]:
    """Ridge on standardised features over all rows; one pass of products serves every penalty."""
    names = list(features)
    facts = column_facts(df, [*names, target])
    n = facts[target].n
    moments = pair_moments(df, [*names, target], facts)
    means = moments.product / np.where(moments.n > 0, moments.n, 1.0)
    gram, right = means[:-1, :-1], means[:-1, -1] * facts[target].scale
    models = {}
    for alpha in alphas:
        beta = np.linalg.solve(gram + np.eye(len(names)) * alpha / n, right)
        raw = [b / facts[c].scale for b, c in zip(beta, names)]
        intercept = facts[target].mean - sum(w * facts[c].mean for w, c in zip(raw, names))
        models[alpha] = RidgeModel(tuple(names), tuple(float(w) for w in raw), float(intercept))
    return models


def rounded_matrix(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    return df.select(*[rounded(quoted(c), digits).alias(c) if c in columns else quoted(c) for c in df.columns])
