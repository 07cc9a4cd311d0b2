"""Queries on forecasts, pooled training, segmentation and anomaly scoring.

Fits of MLlib models and forests have no SQL form; those queries return their metrics or rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query, shown
from millrace.catalog.views import PANEL_GRID_SQL, store_days, table, transaction_log
from millrace.operators import frames, grid, lagging
from millrace.plans import anomaly, forecast as fc, panel_training as pt, segmentation as sg


@query(f"""WITH {PANEL_GRID_SQL}, f AS (SELECT store_id, y, lag(y, 7) OVER o AS a, lag(y, 14) OVER o AS b FROM grid
  WINDOW o AS (PARTITION BY store_id ORDER BY date)),
s AS (SELECT store_id, count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS va, var_pop(b) AS vb,
  covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby FROM f WHERE b IS NOT NULL GROUP BY store_id),
z AS (SELECT *, cab / sqrt(va * vb) AS r, cay / sqrt(va) AS p, cby / sqrt(vb) AS q, 1 + 1 / n AS d FROM s),
w AS (SELECT *, (d * p - r * q) / (d * d - r * r) / sqrt(va) AS wa, (d * q - r * p) / (d * d - r * r) / sqrt(vb) AS wb FROM z)
SELECT CAST(store_id AS BIGINT) AS store_id, round(wa, 6) + 0.0 AS weight_lag_7, round(wb, 6) + 0.0 AS weight_lag_14, round(my - wa * ma - wb * mb, 4) AS intercept FROM w""")
def ridge_per_series(spark, sf_dir):
    """Ridge (alpha 1) of each store's demand on its values one and two weeks before."""
    panel = store_days(spark, sf_dir).select("store_id", F.col("date").alias("period"), F.col("units_sold").alias("y"))
    dense = grid.fill_zero(grid.dense_grid(panel, "D", ["store_id"]), ["y"])
    wide = lagging.series_features(dense, "y", "D", (7, 14), (), (), ["store_id"])
    frame = wide.select(
        "store_id", "period", "y", F.array("lag_7", "lag_14").alias("x"), F.col("lag_14").isNotNull().alias("valid"),
        F.col("lag_14").isNotNull().alias("train"),
    )
    fitted = fc.ridge_per_series(frame, ["store_id"])
    return shown(fitted.select(
        "store_id", F.round(F.col("refit")[0], 6).alias("weight_lag_7"), F.round(F.col("refit")[1], 6).alias("weight_lag_14"),
        F.round("refit_base", 4).alias("intercept"),
    ), 6)


@query(f"""WITH {PANEL_GRID_SQL}, f AS (SELECT y, lag(y, 7) OVER o AS a FROM grid WINDOW o AS (PARTITION BY store_id ORDER BY date)),
t AS (SELECT y, a FROM f WHERE a IS NOT NULL),
s AS (SELECT count(*)::DOUBLE AS n, avg(a) AS ma, avg(y) AS my, var_pop(a) AS va, covar_pop(a, y) AS c FROM t),
w AS (SELECT al.alpha, c / (va * (1 + al.alpha / n)) AS w, ma, my FROM s, (SELECT unnest([0.1, 1.0, 5.0, 10.0, 50.0])::DOUBLE AS alpha) al),
p AS (SELECT alpha, y, greatest(0.0, my + w * (a - ma)) AS prediction FROM t, w)
SELECT alpha, round(coalesce(sqrt(avg(CASE WHEN y >= 50 THEN ((y - prediction) / y) ** 2 END)) * 100, 0), 4) AS rmspe, round(avg(abs(y - prediction)), 4) AS mae,
  round(sqrt(avg((y - prediction) ** 2)), 4) AS rmse, round(1 - sum((y - prediction) ** 2) / (var_pop(y) * count(*)), 4) AS r2, count(*) AS n FROM p GROUP BY alpha""")
def ridge_grid(spark, sf_dir):
    """Five ridge penalties from one pass of products, on the pooled store panel."""
    panel = store_days(spark, sf_dir).select("store_id", F.col("date").alias("period"), F.col("units_sold").alias("y"))
    dense = grid.fill_zero(grid.dense_grid(panel, "D", ["store_id"]), ["y"])
    rows = lagging.series_features(dense, "y", "D", (7,), (), (), ["store_id"]).where("lag_7 IS NOT NULL").select("lag_7", F.col("y").alias("units"))
    return shown(pt.ridge_grid(rows, rows, ["lag_7"], "units"))


def _store_series(spark, sf_dir):
    return fc.prepare_series(store_days(spark, sf_dir), "units_sold", "date", ["store_id"])


@query()
def forecast_panel(spark, sf_dir):
    """Every store's 14-day forecast: contest of ridge and boosted trees, recursion, band."""
    report = fc.run_forecast(_store_series(spark, sf_dir), 14)
    return shown(report.forecast)


@query()
def forecast_contest(spark, sf_dir):
    """Holdout metrics of ridge, boosted trees and the seasonal naive forecast per store, with the winner's skill."""
    report = fc.run_forecast(_store_series(spark, sf_dir), 14)
    return shown(report.metrics.join(report.selection.select("store_id", "selected", "skill"), "store_id"))


@query()
def forecast_revenue(spark, sf_dir):
    """Forecast of the whole log's daily net revenue, with its history for the band chart."""
    prep = fc.prepare_series(transaction_log(spark, sf_dir))
    report = fc.run_forecast(prep, 28)
    rows = frames.forecast_band_rows(report.history, report.forecast, "y", prep.keys)
    return shown(rows)


@query()
def forecast_gate(spark, sf_dir):
    """Store-level gate of a batch of forecasts, summed up per model."""
    report = fc.run_forecast(_store_series(spark, sf_dir), 7)
    return shown(fc.gate_summary(fc.store_gate(report)))


@query()
def pooled_training(spark, sf_dir):
    """Pooled ridge and boosted trees on the store panel; validation metrics of both."""
    trained = pt.train_panel(store_days(spark, sf_dir))
    return shown(trained.metrics)


@query()
def pooled_gates(spark, sf_dir):
    trained = pt.train_panel(store_days(spark, sf_dir))
    return shown(pt.gates(trained.metrics))


@query()
def boosted_grid(spark, sf_dir):
    """The settings of depth 3 and step 0.1 of the boosted-tree grid, all four lengths from one fit of 300 trees."""
    train, valid, features = pt.training_folds(store_days(spark, sf_dir))
    return shown(pt.tree_grid(train, valid, features, "units_sold", {**pt.TREE_GRID, "maxDepth": (3,), "stepSize": (0.1,)}))


@query()
def segment_customers(spark, sf_dir):
    """RFM segmentation of the transaction log: assigned, projected and scored customers."""
    report = sg.run_segmentation(transaction_log(spark, sf_dir, customers=True))
    return shown(report.scored)


@query()
def segment_outliers(spark, sf_dir):
    """The 100 strangest line items, with their cluster."""
    report = sg.run_segmentation(table(spark, sf_dir, "lineitem"))
    return shown(report.outlier_records(keys=("l_orderkey", "l_linenumber")))


@query()
def segment_points(spark, sf_dir):
    report = sg.run_segmentation(transaction_log(spark, sf_dir, customers=True))
    return shown(report.points())


@query()
def cluster_quality(spark, sf_dir):
    """Fixed-feature clustering of the line items with its quality gates."""
    job = sg.cluster_job(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return shown(job.report)


@query()
def embedding_projection(spark, sf_dir):
    """Two principal components of the embeddings."""
    from millrace.operators import clusters, matrix

    rows = table(spark, sf_dir, "embeddings")
    names = [f"e{i}" for i in range(rows.select(F.max(F.size("embedding"))).first()[0])]
    wide = rows.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    ready = clusters.assemble(matrix.standardise(wide, matrix.column_facts(wide, names)), names)
    flat, _ = clusters.project_2d(ready, ready)
    return shown(flat.select("vec_id", "label", "pca_x", "pca_y"))


def _contextual(spark, sf_dir):
    """Store panel with calendar context and a unique row index."""
    days = store_days(spark, sf_dir)
    return days.withColumns({
        "row_index": F.col("store_id").cast("bigint") * 100_000 + F.unix_date("date"),
        "day_of_week": F.weekday("date"), "temperature": F.col("store_id").cast("double"),
    })


@query()
def anomaly_detector(spark, sf_dir):
    """Contextual residuals and isolation forest on the store panel: the flagged rows."""
    found = anomaly.detect(_contextual(spark, sf_dir), id_col="row_index")
    return shown(found.scored.where("is_outlier").select("row_index", "store_id", "date", "units_sold", "anomaly_score"))


@query()
def anomaly_evaluation(spark, sf_dir):
    """Detector judged on labels kept apart: days far from the store's mean count as true anomalies."""
    rows = _contextual(spark, sf_dir)
    found = anomaly.detect(rows, id_col="row_index")
    stats = rows.groupBy("store_id").agg(F.avg("units_sold").alias("m"), F.stddev_samp("units_sold").alias("s"))
    far = F.abs(F.col("units_sold") - F.col("m")) > 2.5 * F.col("s")
    labels = rows.join(stats, "store_id").select("row_index", F.coalesce(far, F.lit(False)).alias("is_anomaly"))
    return shown(anomaly.evaluate(found.scored, labels))
