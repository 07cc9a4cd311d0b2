"""Registry of named queries and the helpers they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.functions.values import quoted
from millrace.sources.sinks import presentable


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function under its name; ``sql`` must return the same columns and rows."""

    def add(run):
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return add


def shown(df: DataFrame, digits: int = 4) -> DataFrame:
    """Rounded doubles, ISO dates and 64-bit integers, so that results compare across engines."""
    df = presentable(df, digits)
    whole = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(*[
        quoted(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, whole) else quoted(f.name) for f in df.schema.fields
    ])
