"""Readers for delimited text and Parquet, and the two benchmark-panel loads with their guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t", "|", ":")


class UnsupportedFormat(ValueError):
    """The extension is not one of csv, tsv, txt, parquet."""


def probe_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless a line holds invalid bytes, then Latin-1. Bytes are judged before any decoding."""
    lines = spark.read.text(path)
    broken = lines.where(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if broken else "UTF-8"


def _open_quote() -> Column:
    """Whether a line holds an odd number of quotes: a cell goes on over the line's end."""
    return F.regexp_count("value", F.lit('"')) % 2 == 1


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether quoted cells hold line breaks. Only then a file must be read as a whole."""
    return not spark.read.text(path).where(_open_quote()).isEmpty()


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter with the same non-zero count on every line outside quotes; the most frequent one wins."""
    lines = spark.read.text(path).where((F.length(F.trim("value")) > 0) & ~_open_quote())
    bare = F.regexp_replace("value", '"[^"]*"', "")
    counts = lines.select(*[(F.length(bare) - F.length(F.replace(bare, F.lit(d)))).alias(f"d{i}") for i, d in enumerate(DELIMITERS)])
    r = counts.agg(
        *[F.min(f"d{i}").alias(f"lo{i}") for i in range(len(DELIMITERS))],
        *[F.max(f"d{i}").alias(f"hi{i}") for i in range(len(DELIMITERS))],
    ).first()
    steady = [(r[f"lo{i}"], -i) for i in range(len(DELIMITERS)) if r[f"lo{i}"] and r[f"lo{i}"] == r[f"hi{i}"]]
    return DELIMITERS[-max(steady)[1]] if steady else ","


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, schema=None, multi_line: bool | None = None
) -> DataFrame:
    """CSV with header. Separator, encoding and line breaks in cells are probed when not given; a schema saves the type pass."""
    reader = (
        spark.read.option("header", True)
        .option("sep", sep or sniff_delimiter(spark, path))
        .option("encoding", encoding or probe_encoding(spark, path))
        .option("quote", '"').option("escape", '"').option("multiLine", has_line_breaks(spark, path) if multi_line is None else multi_line)
    )
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read by extension: csv and txt (comma), tsv (tab), parquet."""
    name = path.lower().rstrip("/")
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith(".tsv"):
        return read_delimited(spark, path, sep="\t", schema=schema)
    if name.endswith((".csv", ".txt")):
        return read_delimited(spark, path, sep="," if name.endswith(".txt") else None, schema=schema)
    raise UnsupportedFormat(f"Unsupported tabular format: {path!r}")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Required columns are missing: {missing}")
    return df


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark panel with a date-typed ``date``; ``row_index`` must come with the data."""
    df = require_columns(spark.read.parquet(path), ["store_id", "date", "units_sold", "row_index"])
    return df.withColumn("date", F.col("date").cast("date"))


def load_labelled(spark: SparkSession, features_path: str, labels_path: str) -> tuple[DataFrame, DataFrame]:
    """Features and labels kept apart: no label among the features, the same number of rows."""
    features, labels = spark.read.parquet(features_path), spark.read.parquet(labels_path)
    check_label_guard(features, labels)
    return features, labels


def check_label_guard(features: DataFrame, labels: DataFrame, flag: str = "is_anomaly") -> None:
    if flag in features.columns:
        raise ValueError(f"Label column {flag!r} leaks into the features.")
    require_columns(labels, [flag])
    n, m = features.count(), labels.count()
    if n != m:
        raise ValueError(f"Features have {n} rows, labels {m}.")
