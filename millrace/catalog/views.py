"""The inputs of the queries: the test tables, read with their columns pruned, and views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transaction_log(spark: SparkSession, sf_dir: str, customers: bool = False) -> DataFrame:
    """Line items as a transaction log; returned lines become credit notes. Orders join only for customers."""
    lines = table(spark, sf_dir, "lineitem")
    back = F.col("l_returnflag") == "R"
    log = lines.select(
        F.when(back, F.concat(F.lit("C"), F.col("l_orderkey"))).otherwise(F.col("l_orderkey").cast("string")).alias("InvoiceNo"),
        F.when(back, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("Quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("UnitPrice"),
        F.col("l_shipdate").alias("InvoiceDate"),
        *([F.col("l_orderkey")] if customers else []),
    )
    if not customers:
        return log
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("CustomerID"))
    return log.join(orders, "l_orderkey").drop("l_orderkey")


LOG_SQL = """log AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'C' || l_orderkey ELSE CAST(l_orderkey AS VARCHAR) END AS inv,
         CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS qty,
         l_extendedprice / l_quantity AS price, l_shipdate AS ts, CAST(l_shipdate AS DATE) AS d, l_orderkey
  FROM lineitem)"""

DAILY_SQL = LOG_SQL + """, daily AS (
  SELECT d, sum(qty * price) AS rev FROM log WHERE NOT (inv LIKE 'C%' AND qty <= 0) AND price > 0 GROUP BY d)"""

REVENUE_GRID_SQL = DAILY_SQL + """, spine AS (
  SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM daily),
grid AS (SELECT spine.d, coalesce(rev, 0.0) AS y, rev IS NULL AS is_gap FROM spine LEFT JOIN daily USING (d))"""


def store_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store panel: units shipped per supplier nation and day."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .groupBy(F.col("s_nationkey").alias("store_id"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(F.sum("l_quantity").alias("units_sold"))
    )


PANEL_SQL = """panel AS (
  SELECT s_nationkey AS store_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS units_sold
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""

PANEL_GRID_SQL = PANEL_SQL + """, spine AS (
  SELECT store_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM panel GROUP BY store_id),
grid AS (
  SELECT store_id, date, units_sold AS raw, coalesce(units_sold, 0.0) AS y, units_sold IS NULL AS is_gap
  FROM spine LEFT JOIN panel USING (store_id, date))"""


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, NULL where unlabelled."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")
