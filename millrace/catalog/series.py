"""Queries on transaction logs, period grids, look-back features and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query, shown
from millrace.catalog.views import (
    DAILY_SQL, LOG_SQL, PANEL_GRID_SQL, PANEL_SQL, REVENUE_GRID_SQL, store_days, table, transaction_log,
)
from millrace.functions.calendar import panel_calendar, series_calendar
from millrace.operators import encoding, frames, grid, lagging, metrics, retail, roles
from millrace.plans import forecast as fc

_DAY = "strftime({}, '%Y-%m-%d')"


@query(f"WITH {DAILY_SQL} SELECT strftime(d, '%Y-%m-%d') AS date, round(rev, 4) AS net_revenue FROM daily")
def daily_net_revenue(spark, sf_dir):
    return shown(retail.daily_net_revenue(transaction_log(spark, sf_dir)))


@query(f"""WITH {LOG_SQL}, f AS (SELECT *, (inv LIKE 'C%' AND qty <= 0) AS cancelled, price > 0 AS priced FROM log)
SELECT count(*) AS rows_in, count(*) FILTER (cancelled) AS cancellation_rows_dropped,
  count(DISTINCT CASE WHEN cancelled THEN inv END) AS cancellation_invoices,
  count(*) FILTER (NOT cancelled AND NOT priced) AS zero_or_negative_price_rows_dropped,
  count(*) FILTER (NOT cancelled AND priced AND qty < 0) AS negative_quantity_rows_kept_as_net_returns,
  count(*) FILTER (NOT cancelled AND priced AND d IS NOT NULL) AS rows_used FROM f""")
def retail_quality_counters(spark, sf_dir):
    return shown(retail.quality_counters(transaction_log(spark, sf_dir)))


@query(f"""WITH {LOG_SQL}, lines AS (
  SELECT CAST(o_custkey AS VARCHAR) AS cid, inv, ts, qty * price AS amount, (inv LIKE 'C%' OR qty < 0) AS ret
  FROM log JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey IS NOT NULL AND o_custkey <> 0),
g AS (SELECT cid, max(ts) AS last, count(DISTINCT inv) AS f,
  coalesce(sum(amount) FILTER (amount > 0), 0.0) AS m, avg(CASE WHEN ret THEN 1.0 ELSE 0.0 END) AS rr
  FROM lines GROUP BY cid)
SELECT cid AS "CustomerID",
  CAST(floor(epoch((SELECT max(ts) FROM lines) + INTERVAL 1 DAY - last) / 86400) AS DOUBLE) AS "Recency",
  CAST(f AS DOUBLE) AS "Frequency", round(m, 4) AS "Monetary", round(ln(1 + m), 4) AS "log1p(Monetary)",
  round(rr, 4) AS "Return Ratio" FROM g""")
def customer_rfm(spark, sf_dir):
    return shown(retail.customer_rfm(transaction_log(spark, sf_dir, customers=True)))


@query(f"""WITH {REVENUE_GRID_SQL}
SELECT strftime(d, '%Y-%m-%d') AS period, round(y, 4) AS y, is_gap FROM grid""")
def prepared_revenue_series(spark, sf_dir):
    """The whole preparation of a transaction log: roles, cadence, dense grid, zero fill."""
    prep = fc.prepare_series(transaction_log(spark, sf_dir))
    return shown(prep.frame.select("period", "y", "is_gap"))


def _window_sql(y: str, order: str, lags, windows) -> str:
    parts = [f"round(lag({y}, {n}) OVER ({order}), 4) AS lag_{n}" for n in lags]
    for w in windows:
        frame = f"OVER ({order} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        full = f"CASE WHEN count({y}) {frame} = {w} THEN "
        for name, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            parts.append(f"{full}round({f}({y}) {frame}, 4) END AS roll{w}_{name}")
    return ", ".join(parts)


_REVENUE_FEATURES_SQL = f"""WITH {REVENUE_GRID_SQL}
SELECT strftime(d, '%Y-%m-%d') AS period, round(y, 4) AS y, is_gap,
  {_window_sql("y", "ORDER BY d", (1, 7, 14, 21, 28), (7, 30))} FROM grid"""


@query(_REVENUE_FEATURES_SQL)
def daily_revenue_features(spark, sf_dir):
    """Flagship: log -> net revenue per day -> calendar spine with zero fill -> lags and rolling statistics."""
    daily = retail.daily_net_revenue(transaction_log(spark, sf_dir)).select(
        F.lit(0).alias("series"), F.col("date").alias("period"), F.col("net_revenue").alias("y")
    )
    dense = grid.fill_zero(grid.dense_grid(daily, "D", ["series"]), ["y"])
    wide = lagging.series_features(dense, "y", "D", (1, 7, 14, 21, 28), (7, 30), (), ["series"])
    names = [n for n in lagging.feature_names("D", (1, 7, 14, 21, 28), (7, 30)) if n.startswith(("lag", "roll"))]
    return shown(wide.select("period", "y", "is_gap", *names))


@query(f"""WITH {PANEL_GRID_SQL}
SELECT CAST(store_id AS BIGINT) AS store_id, strftime(date, '%Y-%m-%d') AS period, round(y, 4) AS units_sold, is_gap FROM grid""")
def calendar_spine_zero_fill(spark, sf_dir):
    dense = grid.dense_grid(store_days(spark, sf_dir).withColumnRenamed("date", "period"), "D", ["store_id"])
    return shown(grid.fill_zero(dense, ["units_sold"]).select("store_id", "period", "units_sold", "is_gap"))


@query(f"""WITH {PANEL_GRID_SQL}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY date) AS pos FROM grid),
ends AS (SELECT *,
  last_value(raw IGNORE NULLS) OVER b AS bv, last_value(CASE WHEN raw IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS bp,
  first_value(raw IGNORE NULLS) OVER a AS av, first_value(CASE WHEN raw IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS ap
  FROM placed WINDOW b AS (PARTITION BY store_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY store_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT CAST(store_id AS BIGINT) AS store_id, strftime(date, '%Y-%m-%d') AS period,
  round(coalesce(raw, CASE WHEN ap > bp THEN bv + (av - bv) * (pos - bp) / (ap - bp) END, bv, av), 4) AS units_sold FROM ends""")
def spine_interpolated(spark, sf_dir):
    dense = grid.dense_grid(store_days(spark, sf_dir).withColumnRenamed("date", "period"), "D", ["store_id"])
    return shown(grid.interpolate_linear(dense, ["units_sold"], ["store_id"]).select("store_id", "period", "units_sold"))


@query("""SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS period, round(sum(o_totalprice), 4) AS o_totalprice,
  round(avg(o_custkey), 4) AS o_custkey, count(*) AS rows FROM orders GROUP BY date_trunc('week', o_orderdate)""")
def resample_weekly(spark, sf_dir):
    return shown(grid.resample(table(spark, sf_dir, "orders"), "o_orderdate", "W", "o_totalprice", "sum", ["o_custkey"]))


@query("""SELECT o_orderpriority, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS period,
  round(avg(o_totalprice), 4) AS o_totalprice, count(*) AS rows FROM orders GROUP BY o_orderpriority, date_trunc('quarter', o_orderdate)""")
def resample_quarterly_mean(spark, sf_dir):
    return shown(grid.resample(
        table(spark, sf_dir, "orders"), "o_orderdate", "Q", "o_totalprice", "mean", (), ["o_orderpriority"]
    ))


@query(f"""WITH {PANEL_GRID_SQL}
SELECT CAST(store_id AS BIGINT) AS store_id, strftime(date, '%Y-%m-%d') AS period, round(y, 4) AS y,
  {_window_sql("y", "PARTITION BY store_id ORDER BY date", (1, 7, 14, 21, 28), (7, 30))} FROM grid""")
def series_look_back(spark, sf_dir):
    """Lags and rolling statistics of every store's dense series."""
    panel = store_days(spark, sf_dir).select("store_id", F.col("date").alias("period"), F.col("units_sold").alias("y"))
    dense = grid.fill_zero(grid.dense_grid(panel, "D", ["store_id"]), ["y"])
    wide = lagging.series_features(dense, "y", "D", (1, 7, 14, 21, 28), (7, 30), (), ["store_id"])
    names = [n for n in lagging.feature_names("D", (1, 7, 14, 21, 28), (7, 30)) if n.startswith(("lag", "roll"))]
    return shown(wide.select("store_id", "period", "y", *names))


def _panel_rolls() -> str:
    order = "PARTITION BY store_id ORDER BY date"
    parts = [f"lag(units_sold, {n}) OVER ({order}) AS lag_{n}" for n in (7, 14, 21, 30)]
    for w in (7, 14, 30):
        frame = f"OVER ({order} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        parts += [f"avg(units_sold) {frame} AS rolling_mean_{w}", f"coalesce(stddev_samp(units_sold) {frame}, 0.0) AS rolling_std_{w}"]
    return ", ".join(parts)


@query(f"""WITH {PANEL_SQL}, f AS (SELECT store_id, date, units_sold, {_panel_rolls()},
  isodow(date) - 1 AS dow, month(date) AS mo, dayofyear(date) AS doy, day(date) AS dom FROM panel)
SELECT CAST(store_id AS BIGINT) AS store_id, strftime(date, '%Y-%m-%d') AS date, round(units_sold, 4) AS units_sold,
  lag_7, lag_14, lag_21, lag_30,
  round(rolling_mean_7, 4) AS rolling_mean_7, round(rolling_std_7, 4) AS rolling_std_7,
  round(rolling_mean_14, 4) AS rolling_mean_14, round(rolling_std_14, 4) AS rolling_std_14,
  round(rolling_mean_30, 4) AS rolling_mean_30, round(rolling_std_30, 4) AS rolling_std_30,
  dow AS day_of_week, dom AS day_of_month, mo AS month, doy AS day_of_year, CAST(dow >= 5 AS BIGINT) AS is_weekend,
  round(sin(2 * pi() * dow / 7), 4) + 0.0 AS sin_dow, round(cos(2 * pi() * dow / 7), 4) + 0.0 AS cos_dow,
  round(sin(2 * pi() * mo / 12), 4) + 0.0 AS sin_month, round(cos(2 * pi() * mo / 12), 4) + 0.0 AS cos_month,
  round(sin(2 * pi() * doy / 365.25), 4) + 0.0 AS sin_doy, round(cos(2 * pi() * doy / 365.25), 4) + 0.0 AS cos_doy
FROM f WHERE lag_30 IS NOT NULL""")
def panel_features(spark, sf_dir):
    return shown(lagging.panel_features(store_days(spark, sf_dir)))


@query("""SELECT o_orderkey, month(d) AS month, quarter(d) AS quarter,
  round(sin(2 * pi() * (month(d) - 1) / 12), 4) + 0.0 AS month_sin, round(cos(2 * pi() * (month(d) - 1) / 12), 4) + 0.0 AS month_cos,
  isodow(d) - 1 AS dow, day(d) AS dom, week(d) AS weekofyear, CAST(isodow(d) >= 6 AS BIGINT) AS is_weekend,
  round(sin(2 * pi() * (isodow(d) - 1) / 7), 4) + 0.0 AS dow_sin, round(cos(2 * pi() * (isodow(d) - 1) / 7), 4) + 0.0 AS dow_cos,
  round(sin(2 * pi() * dayofyear(d) / 365.25), 4) + 0.0 AS sin_doy, round(cos(2 * pi() * month(d) / 12), 4) + 0.0 AS cos_month
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def calendar_cyclic(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    panel = [c for c, n in zip(panel_calendar(F.col("d")), range(99)) if n in (9, 8)]
    return shown(orders.select("o_orderkey", *series_calendar(F.col("d"), "D"), *panel))


@query(f"""WITH {PANEL_GRID_SQL}, c AS (SELECT *, isodow(date) - 1 AS dow FROM grid)
SELECT CAST(store_id AS BIGINT) AS store_id, strftime(date, '%Y-%m-%d') AS period,
  round((coalesce(sum(y) OVER own, 0) + 10 * coalesce(avg(y) OVER every, 0)) / (count(y) OVER own + 10), 4) AS enc_dow
FROM c WINDOW own AS (PARTITION BY store_id, dow ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  every AS (PARTITION BY store_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expanding_mean_encode(spark, sf_dir):
    panel = store_days(spark, sf_dir).select("store_id", F.col("date").alias("period"), F.col("units_sold").alias("y"))
    dense = grid.fill_zero(grid.dense_grid(panel, "D", ["store_id"]), ["y"]).withColumn("dow", F.weekday("period"))
    code = encoding.expanding_encoding(F.col("y"), F.col("dow"), ["store_id"], "period")
    return shown(dense.select("store_id", "period", code.alias("enc_dow")))


@query("""WITH train AS (SELECT o_custkey AS c, o_totalprice AS y FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
g AS (SELECT avg(y) AS g FROM train),
enc AS (SELECT c, (sum(y) + 10 * (SELECT g FROM g)) / (count(*) + 10) AS e FROM train GROUP BY c)
SELECT o_orderkey, round(coalesce(e, (SELECT g FROM g)), 4) AS encoded FROM orders LEFT JOIN enc ON o_custkey = c
WHERE o_orderdate >= TIMESTAMP '2000-01-01'""")
def mean_encode_lookup(spark, sf_dir):
    """Customer encoding of the orders before 2000, looked up by the later ones."""
    orders = table(spark, sf_dir, "orders")
    cut = F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00"))
    codes = encoding.encoding_table(orders.where(F.col("o_orderdate") < cut), "o_totalprice", "o_custkey")
    later = orders.where(F.col("o_orderdate") >= cut).select("o_orderkey", "o_custkey")
    return shown(encoding.apply_encoding(later, codes, "o_custkey", "encoded").select("o_orderkey", "encoded"))


@query(f"""WITH {PANEL_GRID_SQL}, p AS (SELECT store_id, y, lag(y, 1) OVER o AS a, lag(y, 7) OVER o AS b FROM grid
  WINDOW o AS (PARTITION BY store_id ORDER BY date)), m AS (
  SELECT store_id, sqrt(avg((y - a) * (y - a))) AS rmse, sqrt(avg((y - b) * (y - b))) AS naive_rmse FROM p WHERE b IS NOT NULL GROUP BY store_id)
SELECT CAST(store_id AS BIGINT) AS store_id, round(rmse, 4) AS rmse, round(naive_rmse, 4) AS naive_rmse,
  round(1 - rmse / naive_rmse, 4) AS skill FROM m""")
def seasonal_naive_skill(spark, sf_dir):
    """Skill of the last-value forecast over the same-weekday one, per store."""
    panel = store_days(spark, sf_dir).select("store_id", F.col("date").alias("period"), F.col("units_sold").alias("y"))
    dense = grid.fill_zero(grid.dense_grid(panel, "D", ["store_id"]), ["y"])
    wide = lagging.series_features(dense, "y", "D", (1, 7), (), (), ["store_id"]).where("lag_7 IS NOT NULL")
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in (("own", "lag_1"), ("naive", "lag_7"))])
    m = metrics.regression_metrics(wide.select("store_id", "y", F.inline(models)), "y", "p", ["store_id", "model"])
    side = m.groupBy("store_id").agg(
        F.max(F.when(F.col("model") == "own", F.col("rmse"))).alias("rmse"),
        F.max(F.when(F.col("model") == "naive", F.col("rmse"))).alias("naive_rmse"),
    )
    return shown(side.withColumn("skill", metrics.skill(F.col("rmse"), F.col("naive_rmse"))))


@query("""WITH s AS (SELECT unnest([{'k': 'day', 'd': CAST(o_orderdate AS DATE)}, {'k': 'week', 'd': CAST(date_trunc('week', o_orderdate) AS DATE)},
    {'k': 'month', 'd': CAST(date_trunc('month', o_orderdate) AS DATE)}, {'k': 'quarter', 'd': CAST(date_trunc('quarter', o_orderdate) AS DATE)},
    {'k': 'year', 'd': CAST(date_trunc('year', o_orderdate) AS DATE)}]) AS e FROM orders),
u AS (SELECT DISTINCT e.k AS series, e.d AS d FROM s),
g AS (SELECT series, d - lag(d) OVER (PARTITION BY series ORDER BY d) AS gap FROM u),
m AS (SELECT series, count(*) AS n_days, median(gap) AS med FROM g GROUP BY series)
SELECT series, n_days, round(med, 4) AS median_gap, CASE WHEN n_days < 3 THEN NULL WHEN med <= 1.5 THEN 'D' WHEN med BETWEEN 6 AND 8 THEN 'W'
  WHEN med BETWEEN 27 AND 32 THEN 'M' WHEN med BETWEEN 88 AND 93 THEN 'Q' END AS frequency FROM m""")
def frequency_inference(spark, sf_dir):
    """Orders read at five grains: the cadence of each."""
    day = F.col("o_orderdate").cast("date")
    grains = F.array(*[
        F.struct(F.lit(name).alias("series"), value.alias("date"))
        for name, value in [("day", day), *[(u, F.trunc(day, u)) for u in ("week", "month", "quarter", "year")]]
    ])
    orders = table(spark, sf_dir, "orders").select(F.inline(grains))
    return shown(roles.infer_frequency(orders, "date", ["series"]))


@query(f"""WITH {PANEL_SQL}, l AS (SELECT store_id, max(date) AS last FROM panel GROUP BY store_id)
SELECT CAST(store_id AS BIGINT) AS store_id, CAST(step AS BIGINT) AS step, strftime(last + CAST(step AS INTEGER), '%Y-%m-%d') AS period
FROM l, generate_series(1, 14) AS t(step)""")
def future_period_labels(spark, sf_dir):
    last = store_days(spark, sf_dir).groupBy("store_id").agg(F.max("date").alias("period"))
    return shown(grid.future_periods(last, "D", 14).select("store_id", "step", "period"))


@query(f"""WITH {PANEL_GRID_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY date DESC) AS back FROM grid)
SELECT CAST(store_id AS BIGINT) AS store_id, strftime(date, '%Y-%m-%d') AS period, round(y, 4) AS units_sold FROM r WHERE back <= 365""")
def recent_periods(spark, sf_dir):
    dense = grid.dense_grid(store_days(spark, sf_dir).withColumnRenamed("date", "period"), "D", ["store_id"])
    return shown(frames.recent(grid.fill_zero(dense, ["units_sold"]), ["store_id"]).select("store_id", "period", "units_sold"))


@query(f"""WITH {PANEL_GRID_SQL}, c AS (SELECT *, last_value(raw IGNORE NULLS) OVER
  (PARTITION BY store_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM grid)
SELECT CAST(store_id AS BIGINT) AS store_id, strftime(date, '%Y-%m-%d') AS period, round(v, 4) AS units_sold FROM c""")
def carried_inputs(spark, sf_dir):
    """Last known value carried over the gaps, as for future inputs."""
    dense = grid.dense_grid(store_days(spark, sf_dir).withColumnRenamed("date", "period"), "D", ["store_id"])
    return shown(grid.carry_last(dense, ["units_sold"], ["store_id"]).select("store_id", "period", "units_sold"))


@query(f"""WITH {PANEL_SQL}, d AS (SELECT DISTINCT date FROM panel), r AS (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM d),
cut AS (SELECT date AS c FROM r WHERE pos = floor(n * 0.8))
SELECT CASE WHEN date < c THEN 'train' ELSE 'validation' END AS fold, count(*) AS rows, count(DISTINCT date) AS dates,
  strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date, round(sum(units_sold), 4) AS units
FROM panel, cut GROUP BY 1""")
def time_split_folds(spark, sf_dir):
    from millrace.plans.panel_training import time_split

    train, valid = time_split(store_days(spark, sf_dir))
    both = train.withColumn("fold", F.lit("train")).unionByName(valid.withColumn("fold", F.lit("validation")))
    return shown(both.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("date").alias("dates"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"), F.sum("units_sold").alias("units"),
    ))


@query("""WITH days AS (
  SELECT s_nationkey AS store_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS units, avg(CASE WHEN l_discount > 0.02 THEN l_discount END) AS promo
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT store_id, strftime(date, '%Y-%m-%d') AS date, round(lag(units, 1) OVER w, 4) AS lag_1, round(lag(promo, 1) OVER w, 4) AS x_promo_lag1
FROM days WINDOW w AS (PARTITION BY store_id ORDER BY date)""")
def exogenous_lag(spark, sf_dir):
    """An input column with missing values, one period back, beside the lag of the target."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_discount")
    joined = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    days = joined.groupBy(F.col("s_nationkey").alias("store_id"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum("l_quantity").alias("units"), F.avg(F.when(F.col("l_discount") > 0.02, F.col("l_discount"))).alias("promo"),
    )
    found = lagging.series_features(days, "units", "D", [1], [], ["promo"], keys=["store_id"], period="date")
    return shown(found.select("store_id", "date", "lag_1", "x_promo_lag1"))


@query(f"""WITH {PANEL_SQL}
SELECT store_id, count(*) AS days, round(avg(units_sold), 4) AS mean_units FROM panel WHERE dayofweek(date) <> 0 GROUP BY store_id""")
def trading_day_means(spark, sf_dir):
    """Mean units of the days on which a store trades: all but Sundays."""
    days = store_days(spark, sf_dir).withColumn("Open", (F.weekday("date") != 6).cast("int"))
    open_days = retail.trading_days(days).groupBy("store_id")
    return shown(open_days.agg(F.count(F.lit(1)).alias("days"), F.avg("units_sold").alias("mean_units")))
