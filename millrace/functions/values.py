"""Small value expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that make a spreadsheet read a cell as a formula.
FORMULA_MARKS = "=@+-\t\r\n＝＠＋－"
_MARK_CLASS = r"[=@+\-\t\r\n＝＠＋－]"
# Python counts \x1c-\x1f as white space too, Java's (?U)\s does not.
BLANK = r"[\s\x1c-\x1f]"

ISO_DATE = r"^\s*\d{4}[-/]\d{1,2}([-/]\d{1,2})?"
TRIPLE_DATE = r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})"

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_integer(field: T.StructField) -> bool:
    return isinstance(field.dataType, _INTEGERS)


def is_float(field: T.StructField) -> bool:
    return isinstance(field.dataType, _FLOATS)


def is_number(field: T.StructField) -> bool:
    return is_integer(field) or is_float(field)


def is_boolean(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.BooleanType)


def is_date(field: T.StructField) -> bool:
    return isinstance(field.dataType, _DATES)


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


def quoted(name: str) -> Column:
    """Column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_number(field: T.StructField) -> Column:
    """The column with NaN turned into NULL, so that there is one notion of missing."""
    column = quoted(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return column


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise every floating column in one projection."""
    return df.select(
        *[
            clean_number(f).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def rounded(value: Column, digits: int = 4) -> Column:
    """Rounded double without a negative zero."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def iso_day(value: Column) -> Column:
    return F.date_format(value.cast("date"), "yyyy-MM-dd")


def quote_formula(value: Column) -> Column:
    """Prefix an apostrophe when the cell, or the cell after left trim, starts as a formula."""
    risky = value.rlike(rf"(?U)\A{BLANK}*{_MARK_CLASS}")
    return F.when(risky, F.concat(F.lit("'"), value)).otherwise(value)


def strip_formula(value: Column) -> Column:
    """Drop leading white space and formula marks of risky cells; leave the others untouched."""
    return F.regexp_replace(value, rf"(?U)\A{BLANK}*{_MARK_CLASS}+", "")


def whole_label(value: Column, field: T.StructField) -> Column:
    """Group label: whole floats print as integers, booleans capitalised."""
    text = value.cast("string")
    if is_float(field):
        number = value.cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) < 9e15)
        return F.when(whole, number.cast("bigint").cast("string")).otherwise(text)
    if is_boolean(field):
        return F.initcap(text)
    return text


def lift_percent(base: Column, other: Column) -> Column:
    return rounded((F.try_divide(other, base) - 1) * 100, 2)


def log_ratio(actual: Column, expected: Column) -> Column:
    return F.log((actual + 1.0) / (F.greatest(expected, F.lit(1.0)) + 1.0))
