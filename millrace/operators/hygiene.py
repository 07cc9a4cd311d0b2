"""Table hygiene: formula neutralisation, safe header names, down-casts, imputation, categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.values import (
    FORMULA_MARKS, clean_number, is_number, is_text, quote_formula, quoted, strip_formula,
)
from millrace.operators.order_stats import DIRECT_ROWS, medians

MAX_CELL_CHARS = 10 * 1024 * 1024


def neutralise_formulas(df: DataFrame, method: str = "quote") -> DataFrame:
    """Neutralise spreadsheet formulas in every text cell and header; one projection."""
    action = {"quote": quote_formula, "strip": strip_formula}[method.strip().lower()]
    names = safe_headers(df.columns, method)
    return df.select(
        *[(action(quoted(f.name)) if is_text(f) else quoted(f.name)).alias(n) for f, n in zip(df.schema.fields, names)]
    )


def safe_headers(names: Sequence[str], method: str = "quote") -> list[str]:
    """Neutralised header names, made unique as name, name.1, name.2 (ignoring case, as Spark does)."""
    taken: set[str] = set()
    out = []
    for name in names:
        bare = name.lstrip()
        risky = bool(name) and (name[0] in FORMULA_MARKS or bare[:1] in tuple(FORMULA_MARKS))
        if risky:
            name = bare.lstrip(FORMULA_MARKS) if method.strip().lower() == "strip" else f"'{name}"
        free, n = name, 0
        while free.lower() in taken:
            n += 1
            free = f"{name}.{n}"
        taken.add(free.lower())
        out.append(free)
    return out


# Integer ranges and the largest finite single-precision number.
_SHORT, _INT, _FLOAT = 2**15, 2**31, 3.4028234663852886e38


def downcast_plan(df: DataFrame) -> dict[str, T.DataType]:
    """Narrowest safe type per bigint and double column, from one min/max pass."""
    wide = [f for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.DoubleType))]
    if not wide:
        return {}
    row = df.agg(
        *[F.min(clean_number(f)).alias(f"lo{i}") for i, f in enumerate(wide)],
        *[F.max(clean_number(f)).alias(f"hi{i}") for i, f in enumerate(wide)],
    ).first()
    plan: dict[str, T.DataType] = {}
    for i, f in enumerate(wide):
        low, high = row[f"lo{i}"], row[f"hi{i}"]
        if isinstance(f.dataType, T.DoubleType):
            if low is None or (-_FLOAT <= low and high <= _FLOAT):
                plan[f.name] = T.FloatType()
        elif low is None or (-_SHORT <= low and high < _SHORT):
            plan[f.name] = T.ShortType()
        elif -_INT <= low and high < _INT:
            plan[f.name] = T.IntegerType()
    return plan


def downcast(df: DataFrame) -> DataFrame:
    plan = downcast_plan(df)
    return df.select(*[quoted(c).cast(plan[c]).alias(c) if c in plan else quoted(c) for c in df.columns])


def longest_cells(df: DataFrame) -> DataFrame:
    """Longest cell per text column; one pass."""
    texts = [f.name for f in df.schema.fields if is_text(f)]
    lengths = df.agg(*[F.max(F.char_length(quoted(c))).alias(f"m{i}") for i, c in enumerate(texts)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("longest")) for i, c in enumerate(texts)])
    return lengths.select(F.inline(rows))


def guard_cell_length(df: DataFrame, limit: int = MAX_CELL_CHARS) -> DataFrame:
    if any(is_text(f) for f in df.schema.fields):
        worst = longest_cells(df).agg(F.max("longest")).first()[0] or 0
        if worst > limit:
            raise ValueError(f"A cell has {worst:,} characters, the limit is {limit:,}.")
    return df


def impute_for_models(df: DataFrame, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Fill numbers with the column median and text with "missing"; flag what was filled.

    A ``{column}_was_missing`` flag appears only for columns that hold NULLs. The null counts take one
    pass, the medians of the columns that need one another.
    """
    fields = df.schema.fields
    held = df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count(clean_number(f)).alias(f"c{i}") for i, f in enumerate(fields)]
    ).first()
    gappy = {f.name for i, f in enumerate(fields) if held[f"c{i}"] < held["total"]}
    middle = medians(df, {f.name: clean_number(f) for f in fields if f.name in gappy and is_number(f)}, direct_rows)
    columns, flags = [], []
    for f in fields:
        value = clean_number(f)
        if f.name not in gappy:
            columns.append(quoted(f.name))
            continue
        flags.append(value.isNull().alias(f"{f.name}_was_missing"))
        if is_number(f):
            # A whole-number column becomes fractional when its median is.
            keep = f.dataType if isinstance(f.dataType, (T.FloatType, T.DecimalType)) else T.DoubleType()
            columns.append(F.coalesce(value.cast(keep), F.lit(middle[f.name]).cast(keep)).alias(f.name))
        elif is_text(f):
            columns.append(F.coalesce(value, F.lit("missing")).alias(f.name))
        else:
            columns.append(value.alias(f.name))
    return df.select(*columns, *flags)


def category_levels(train: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct levels of each category column in the training rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), quoted(c).cast("string").alias("level")) for c in columns])
    rows = train.select(F.inline(pairs)).where("level IS NOT NULL").distinct().orderBy("name", "level").collect()
    return {c: [r["level"] for r in rows if r["name"] == c] for c in columns}


def one_hot(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """0/1 columns ``{column}_{level}`` without the first level; unknown levels are all zero."""
    added = [
        F.coalesce((quoted(c).cast("string") == level).cast("int"), F.lit(0)).alias(f"{c}_{level}")
        for c, known in levels.items() for level in known[1:]
    ]
    return df.select(*[quoted(c) for c in df.columns if c not in levels], *added)
