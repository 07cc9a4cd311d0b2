"""Exact order statistics that never gather a group into one task.

``exact_quantiles`` counts the rows of each value once; the totals of value buckets tell where a wanted
rank is, and only the values of its bucket are put in order.
``value_positions`` ranks values by two phases: totals per value bucket, then positions inside it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.values import quoted
from millrace.session import durable, small_side

# Up to this many rows per group Spark's exact `percentile` is used as is.
DIRECT_ROWS = 1_000_000
_ACCURACY = 10_000
# Share of the rows to each side of a wanted rank between whose sketched values it is looked for, twice the error of the sketch.
_REACH = 2e-4
_MAX_BUCKETS = 4096
_ROWS_PER_BUCKET = 500_000


def _wanted(n: int, prob: float) -> tuple[int, int, float]:
    place = (n - 1) * prob
    low = math.floor(place)
    return low, min(low + 1, n - 1), place - low


def exact_quantiles(
    df: DataFrame,
    value: Column,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    direct_rows: int = DIRECT_ROWS,
    sizes: dict[tuple, int] | None = None,
    copies: str | None = None,
) -> dict[tuple, list[float]]:
    """Linear-interpolated quantiles per group, on the driver: one short list per group.

    Meant for few groups (columns, levels); NULL values are ignored and empty groups are absent.
    ``sizes`` gives the non-null rows per group when the caller knows them, which saves a pass. ``copies`` names the column of a
    frame that has one row per group and value, with the rows that hold it.
    """
    keys = list(keys)
    count = quoted(copies) if copies else F.lit(1)
    data = df.select(*keys, value.cast("double").alias("_v"), count.cast("bigint").alias("_n")).where("_v IS NOT NULL")
    sizes = sizes or {tuple(r[k] for k in keys): r["n"] for r in data.groupBy(*keys).agg(F.sum("_n").alias("n")).collect()}
    sizes = {k: n for k, n in sizes.items() if n}
    if not sizes:
        return {}
    if max(sizes.values()) <= direct_rows:
        rows = data.groupBy(*keys).agg(F.percentile("_v", [float(p) for p in probs], F.col("_n")).alias("q")).collect()
        return {tuple(r[k] for k in keys): list(r["q"]) for r in rows if r["q"] is not None}
    if not keys and not copies and len(probs) == 1:
        found = _near_rank(data, sizes[()], float(probs[0]))
        if found is not None:
            return {(): [found]}
    counts = data if copies else durable(data.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")))
    return _by_counts(counts, keys, sizes, [float(p) for p in probs])


def _near_rank(data: DataFrame, n: int, prob: float) -> float | None:
    """A quantile from the values between two sketched ones around it alone, so that the others are not shuffled; None if they miss it."""
    marks = [max(prob - _REACH, 0.0), min(prob + _REACH, 1.0)]
    low, high = data.agg(F.percentile_approx("_v", marks, _ACCURACY).alias("marks")).first()["marks"]
    if not (math.isfinite(low) and math.isfinite(high)):
        return None
    counts = durable(data.where(F.col("_v").between(low, high)).groupBy("_v").agg(F.count(F.lit(1)).alias("_n")))
    below = data.where(F.col("_v") < low).count()
    first, last, _ = _wanted(n, prob)
    if below > first or last >= below + (counts.agg(F.sum("_n")).first()[0] or 0):
        return None
    return _by_counts(counts, [], {(): n}, [prob], below)[()][0]


def _by_counts(counts, keys, sizes, probs, below=0):
    """Wanted ranks from rows per value (``_v``, ``_n``): totals of value buckets tell the bucket of a rank, positions inside it the value.

    ``below`` rows have lesser values that are not among the counts."""
    spark = counts.sparkSession
    bucketed = value_buckets(counts, "_v", counts.count())
    totals = bucketed.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_held"))
    upto = F.sum("_held").over(Window.partitionBy(*keys).orderBy("_bucket"))
    starts = totals.withColumn("_start", upto - F.col("_held") + below)
    wanted = sorted({(i, rank) for i, (k, n) in enumerate(sizes.items()) for p in probs for rank in _wanted(n, p)[:2]})
    named = list(sizes)
    key_fields = [f for f in counts.schema.fields if f.name in keys]
    schema = T.StructType([T.StructField(f"_k_{f.name}", f.dataType) for f in key_fields]).add("_at", T.IntegerType()).add("_rank", T.LongType())
    order = [keys.index(f.name) for f in key_fields]
    targets = spark.createDataFrame([(*[named[i][o] for o in order], i, rank) for i, rank in wanted], schema)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_held"))
    # One row per wanted rank; only the values of their buckets are put in order.
    places = starts.join(small_side(targets, len(wanted)), same & inside)
    places = [(r["_at"], r["_rank"], r["_bucket"], r["_start"]) for r in places.collect()]
    if len(places) != len(wanted):
        raise RuntimeError("a wanted rank is in no bucket of values")
    held = T.StructType(schema.fields[:-1]).add("_b", T.DoubleType()).add("_start", T.LongType()).add("_ranks", T.ArrayType(T.LongType()))
    near: dict[tuple, list[int]] = {}
    for at, rank, bucket, start in places:
        near.setdefault((at, bucket, start), []).append(rank)
    side = spark.createDataFrame([(*[named[at][o] for o in order], at, bucket, start, ranks) for (at, bucket, start), ranks in near.items()], held)
    rows = bucketed.join(small_side(side, len(near)), same & (F.col("_bucket") == F.col("_b")))
    end = F.col("_start") + F.sum("_n").over(Window.partitionBy("_at", "_bucket").orderBy("_v"))
    hit = F.filter("_ranks", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_n")))
    spots = rows.withColumn("_end", end).select("_at", "_v", F.explode(hit).alias("_rank"))
    found = {(r["_at"], r["_rank"]): r["_v"] for r in spots.collect()}
    out: dict[tuple, list[float]] = {}
    for i, (key, n) in enumerate(sizes.items()):
        row = []
        for p in probs:
            low, high, part = _wanted(n, p)
            a, b = found[(i, low)], found[(i, high)]
            row.append(a + (b - a) * part if a != b else a)
        out[key] = row
    return out


def medians(df: DataFrame, columns: dict[str, Column], direct_rows: int = DIRECT_ROWS) -> dict[str, float]:
    """Exact median of several columns together; all-NULL columns give 0.0."""
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in columns.items()])
    table = exact_quantiles(df.select(F.inline(pairs)), F.col("value"), [0.5], ["name"], direct_rows)
    return {n: table[(n,)][0] if (n,) in table else 0.0 for n in columns}


def value_buckets(df: DataFrame, value: str, rows: int, bucket: str = "_bucket") -> DataFrame:
    """Attach an order-preserving bucket number so that each bucket holds a bounded share of the values."""
    wanted = min(_MAX_BUCKETS, math.ceil(rows / _ROWS_PER_BUCKET))
    if wanted < 2:
        return df.withColumn(bucket, F.lit(0.0))
    inner = [i / wanted for i in range(1, wanted)]
    cuts = df.agg(F.percentile_approx(value, inner, _ACCURACY).alias("cuts")).first()["cuts"] or []
    splits = [-math.inf, *sorted(c for c in set(cuts) if math.isfinite(c)), math.inf]
    if len(splits) < 3:
        return df.withColumn(bucket, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=value, outputCol=bucket, handleInvalid="keep").transform(df)


def value_positions(
    counts: DataFrame, keys: Sequence[str], value: str, count: str, rows: int, carry: dict[str, Column] | None = None
) -> DataFrame:
    """Per distinct value of a group: rows holding it (``tied``) and rows below it (``below``).

    ``counts`` has one row per group and distinct value (or several that are summed here);
    ``rows`` is the number of raw rows behind it and only sets the bucket number. ``carry`` adds
    aggregates of the summed rows to the result, which saves joining them back.
    """
    keys, carry = list(keys), carry or {}
    per_value = (
        value_buckets(counts, value, rows)
        .groupBy(*keys, "_bucket", value)
        .agg(F.sum(count).alias("tied"), *[c.alias(n) for n, c in carry.items()])
    )
    totals = per_value.groupBy(*keys, "_bucket").agg(F.sum("tied").alias("_held"))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_bucket", F.coalesce(F.sum("_held").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        per_value.join(starts, [*keys, "_bucket"])
        .withColumn("below", F.col("_start") + F.coalesce(F.sum("tied").over(inside), F.lit(0)))
        .select(*keys, value, "tied", "below", *carry)
    )
