"""Table profile: nulls, semantic types and the overview made of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import clean_number, is_boolean, is_date, is_float, is_integer, is_number, is_text, quoted

# The words that make a text column boolean.
BOOLEAN_WORDS = ("true", "false", "t", "f", "yes", "no")
_SKETCH_ERROR = 0.02


def null_profile(df: DataFrame) -> DataFrame:
    """Raw null count and percentage per column; one pass, one output row per column."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count(clean_number(f)).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]
    )
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("column_name"), F.col(f"c{i}").alias("held"))
        for i, name in enumerate(df.columns)
    ])
    missing = F.col("total") - F.col("held")
    return counts.select("total", F.inline(rows)).select(
        "position",
        "column_name",
        missing.alias("null_count"),
        F.coalesce(F.round(F.try_divide(missing * 100.0, F.col("total")), 2), F.lit(0.0)).alias("null_percentage"),
        F.col("total").alias("total_rows"),
    )


def _text_facts(df: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), quoted(n).alias("v")) for n in names])
    word = F.lower(F.trim("v"))
    length = F.char_length("v")
    parsed = F.coalesce(
        F.col("v").try_cast("timestamp"), F.try_to_timestamp("v", F.lit("M/d/yyyy")), F.try_to_timestamp("v", F.lit("M/d/yyyy H:mm")),
        *[F.try_to_timestamp("v", F.lit(p)) for p in (
            "d-M-yyyy", "d.M.yyyy", "d/M/yyyy", "d/M/yyyy H:mm", "yyyy/M/d", "yyyy/M/d H:mm", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd",
        )],
    )
    # A bare short number casts to a year in Spark; it is not a date string.
    # The cheap pattern comes first, so that only likely values are parsed.
    dated = F.col("v").rlike(r"\d[-/.:]\d|^\s*\d{1,2} \p{L}{3,9} \d{4}|^\s*\p{L}{3,9} \d{1,2}, \d{4}|^\d{8}$") & parsed.isNotNull()
    return (
        df.select(F.inline(pairs)).where("v IS NOT NULL")
        .groupBy("column_name")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(length).alias("longest"),
            F.avg(length).alias("mean_length"),
            F.bool_and(word.isin(*BOOLEAN_WORDS)).alias("boolean_words"),
            F.avg(F.when(length <= 100, dated).otherwise(False).cast("double")).alias("date_share"),
            F.bool_or(F.contains("v", F.lit(" "))).alias("has_space"),
            F.approx_count_distinct("v", _SKETCH_ERROR).alias("uniques"),
        )
    )


def semantic_types(df: DataFrame) -> DataFrame:
    """Semantic type per column: boolean, text, datetime, numeric or categorical.

    One pass holds every fact. Distinct counts come from a sketch; only columns for which the sketch
    is too close to a cut (20 values, ratio 0.1 or 0.5) are counted exactly afterwards.
    """
    spark = df.sparkSession
    out: dict[str, str] = {}
    texts: list[str] = []
    typed_aggs = []
    for i, f in enumerate(df.schema.fields):
        if is_boolean(f):
            out[f.name] = "boolean"
        elif is_date(f):
            typed_aggs.append(F.count(quoted(f.name)).alias(f"n{i}"))
        elif is_number(f):
            typed_aggs.append(F.count(clean_number(f)).alias(f"n{i}"))
            if is_integer(f):
                typed_aggs.append(F.bool_and(quoted(f.name).isin(0, 1)).alias(f"b{i}"))
        elif is_text(f):
            texts.append(f.name)
        else:
            out[f.name] = "text"
    if typed_aggs:
        row = df.agg(*typed_aggs).first()
        for i, f in enumerate(df.schema.fields):
            if is_date(f) and not is_boolean(f):
                out[f.name] = "datetime" if row[f"n{i}"] else "text"
            elif is_number(f):
                flag = is_integer(f) and row[f"b{i}"]
                out[f.name] = "text" if not row[f"n{i}"] else "boolean" if flag else "numeric"
    if texts:
        facts = {r["column_name"]: r for r in _text_facts(df, texts).collect()}
        for name in texts:
            out[name] = _text_type(df, name, facts[name]) if name in facts else "text"
    rows = [(i, c, out[c]) for i, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "position int, column_name string, inferred_type string")


def _text_type(df: DataFrame, name: str, r) -> str:
    if r["longest"] > 100:
        return "text"
    if r["boolean_words"]:
        return "boolean"
    if r["date_share"] > 0.8:
        return "datetime"
    if r["mean_length"] > 50:
        return "text"
    n, uniques = r["n"], r["uniques"]
    room = 6 * _SKETCH_ERROR * uniques + 2
    if any(abs(uniques - cut) <= room for cut in (20, 0.1 * n, 0.5 * n)):
        uniques = df.select(quoted(name).alias("v")).where("v IS NOT NULL").distinct().count()
    ratio = uniques / n
    if r["mean_length"] > 20 and ratio > 0.5 and r["has_space"]:
        return "text"
    return "categorical" if uniques <= 20 or ratio < 0.1 else "text"


def table_overview(df: DataFrame) -> DataFrame:
    """One row per column: name, semantic type, nulls, and the table's row and column counts."""
    return (
        null_profile(df)
        .join(F.broadcast(semantic_types(df).drop("position")), "column_name")
        .withColumn("column_count", F.lit(len(df.columns)))
        .orderBy("position")
    )
