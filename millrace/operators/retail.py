"""Transaction logs: recognition by column names, cleaning, daily net revenue, customer RFM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.values import is_integer, quoted
from millrace.operators.roles import date_values, resolve_column
from millrace.session import durable

_CUSTOMER = ("customerid", "customer_id", "client_id")


@dataclass(frozen=True)
class LogColumns:
    invoice: str
    quantity: str
    price: str
    date: str
    customer: str | None = None


def transaction_columns(df: DataFrame) -> LogColumns | None:
    """The four columns of a transaction log, or None when one is absent."""
    found = [resolve_column(df.columns, n) for n in ("invoiceno", "quantity", "unitprice", "invoicedate")]
    return LogColumns(*found, resolve_column(df.columns, *_CUSTOMER)) if all(found) else None


def rfm_columns(df: DataFrame) -> LogColumns | None:
    """Columns of a transaction log that names its customers."""
    cols = transaction_columns(df)
    return cols if cols and cols.customer else None


def _is_cancellation(cols: LogColumns) -> Column:
    credit_note = quoted(cols.invoice).cast("string").startswith("C") & (quoted(cols.quantity) <= 0)
    return F.coalesce(credit_note, F.lit(False))


def _has_price(cols: LogColumns) -> Column:
    return F.coalesce(quoted(cols.price) > 0, F.lit(False))


def sales_lines(df: DataFrame, cols: LogColumns) -> DataFrame:
    """Lines without cancellations and without missing, zero or negative prices."""
    return df.where(~_is_cancellation(cols) & _has_price(cols))


def trading_days(df: DataFrame, flag: str = "Open") -> DataFrame:
    """Rows of days on which the store was open."""
    return df.where(quoted(flag) == 1)


def daily_net_revenue(df: DataFrame, cols: LogColumns | None = None, order_col: str | None = None) -> DataFrame:
    """(date, net_revenue); returns stay in as negative amounts."""
    cols = cols or transaction_columns(df)
    day, _ = date_values(df, cols.date, order_col)
    amount = quoted(cols.quantity).cast("double") * quoted(cols.price).cast("double")
    return (
        sales_lines(df, cols)
        .select(day.alias("date"), amount.alias("amount"))
        .where("date IS NOT NULL")
        .groupBy("date")
        .agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("net_revenue"))
    )


def quality_counters(df: DataFrame, cols: LogColumns | None = None) -> DataFrame:
    """One row of counters; each looks only at the rows that passed the earlier filters.

    Lines are first combined per cancelled invoice (others share one group), so that no task
    sees all lines and the distinct count is a plain count.
    """
    cols = cols or transaction_columns(df)
    day, _ = date_values(df, cols.date)
    cancelled, priced = _is_cancellation(cols), _has_price(cols)
    kept = ~cancelled & priced
    parts = df.groupBy(F.when(cancelled, quoted(cols.invoice).cast("string")).alias("credit_note")).agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(cancelled).alias("cancelled"),
        F.count_if(~cancelled & ~priced).alias("unpriced"),
        F.count_if(kept & (quoted(cols.quantity) < 0)).alias("returned"),
        F.count_if(kept & day.isNotNull()).alias("used"),
    )
    return parts.agg(
        F.sum("rows_in").alias("rows_in"),
        F.sum("cancelled").alias("cancellation_rows_dropped"),
        F.count("credit_note").alias("cancellation_invoices"),
        F.sum("unpriced").alias("zero_or_negative_price_rows_dropped"),
        F.sum("returned").alias("negative_quantity_rows_kept_as_net_returns"),
        F.sum("used").alias("rows_used"),
    )


def customer_key(df: DataFrame, column: str) -> Column:
    """Customer id as text; whole floats lose their fraction, NULL and "0" are to be filtered."""
    raw = quoted(column)
    if is_integer(df.schema[column]):
        return raw.cast("string")
    return F.coalesce(raw.try_cast("double").try_cast("bigint").cast("string"), raw.cast("string"))


def customer_rfm(df: DataFrame, cols: LogColumns | None = None) -> DataFrame:
    """Recency, Frequency, Monetary, log1p(Monetary) and Return Ratio per customer.

    Lines are combined per (customer, invoice) before they are combined per customer: a customer
    holding a large share of all lines is spread over its invoices, and the distinct invoice count
    is a plain count. The reference date is the latest of the customers' last dates.
    """
    cols = cols or rfm_columns(df)
    when = quoted(cols.date)
    if not isinstance(df.schema[cols.date].dataType, (T.TimestampType, T.TimestampNTZType)):
        when = date_values(df, cols.date)[0].cast("timestamp_ntz")
    quantity = F.coalesce(quoted(cols.quantity).try_cast("double"), F.lit(0.0))
    price = F.coalesce(quoted(cols.price).try_cast("double"), F.lit(0.0))
    invoice = quoted(cols.invoice).cast("string")
    lines = df.select(
        customer_key(df, cols.customer).alias("CustomerID"),
        invoice.alias("invoice"),
        when.alias("at"),
        (quantity * price).alias("amount"),
        (F.coalesce(invoice.startswith("C"), F.lit(False)) | (quantity < 0)).cast("int").alias("is_return"),
    ).where("CustomerID IS NOT NULL AND CustomerID <> '0'")
    per_invoice = lines.groupBy("CustomerID", "invoice").agg(
        F.max("at").alias("at"),
        F.sum(F.when(F.col("amount") > 0, F.col("amount"))).alias("spent"),
        F.count(F.lit(1)).alias("lines"),
        F.sum("is_return").alias("returns"),
    )
    per_customer = per_invoice.groupBy("CustomerID").agg(
        F.max("at").alias("last"),
        F.count("invoice").alias("invoices"),
        F.coalesce(F.sum("spent"), F.lit(0.0)).alias("Monetary"),
        (F.sum("returns") / F.sum("lines")).alias("Return Ratio"),
    )
    # One row per customer, stored, so that the reference date does not run the lines a second time.
    per_customer = durable(per_customer)
    latest = per_customer.agg(F.max("last").alias("latest")).scalar()
    # The difference of two timestamps is an interval; its day part is the number of whole days.
    days = F.extract(F.lit("DAY"), latest + F.expr("INTERVAL 1 DAY") - F.col("last"))
    return per_customer.select(
        "CustomerID",
        F.coalesce(days.cast("double"), F.lit(0.0)).alias("Recency"),
        F.col("invoices").cast("double").alias("Frequency"),
        "Monetary",
        F.log1p(F.greatest(F.lit(0.0), "Monetary")).alias("log1p(Monetary)"),
        "Return Ratio",
    )
