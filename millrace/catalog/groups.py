"""Queries on group statistics, test statistics, ranks, corrections, and error metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query, shown
from millrace.catalog.views import PANEL_GRID_SQL, store_days, table
from millrace.functions.values import lift_percent
from millrace.operators import frames, grid, metrics
from millrace.operators import group_stats as gs
from millrace.operators.order_stats import exact_quantiles
from millrace.plans import hypotheses as hy

_LONG = """long AS (SELECT 'o_orderpriority' AS grouping_column, o_orderpriority AS level, o_totalprice AS y FROM orders
  UNION ALL SELECT 'o_orderstatus', o_orderstatus, o_totalprice FROM orders)"""


def _order_groups(spark, sf_dir):
    return gs.long_groups(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority", "o_orderstatus"])


@query(f"""WITH {_LONG} SELECT grouping_column, level, count(*) AS n, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS std,
  round(min(y), 4) AS min, round(quantile_cont(y, 0.25), 4) AS q1, round(median(y), 4) AS median, round(quantile_cont(y, 0.75), 4) AS q3,
  round(max(y), 4) AS max, round(avg(y) - stddev_samp(y), 4) AS low, round(avg(y) + stddev_samp(y), 4) AS high FROM long GROUP BY 1, 2""")
def group_stats(spark, sf_dir):
    """Group statistics with exact quartiles and the mean's error bars."""
    long = _order_groups(spark, sf_dir)
    found = exact_quantiles(long, F.col("y"), [0.25, 0.5, 0.75], ["grouping_column", "level"])
    quart = spark.createDataFrame([(*k, *v) for k, v in found.items()], "grouping_column string, level string, q1 double, median double, q3 double")
    stats = gs.level_moments(long).withColumn("std", F.sqrt("variance")).join(F.broadcast(quart), ["grouping_column", "level"])
    return shown(frames.error_bars(stats.select("grouping_column", "level", "n", "mean", "std", "min", "q1", "median", "q3", "max")))


@query("""SELECT l_returnflag, round(min(l_extendedprice), 4) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
  round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, round(max(l_extendedprice), 4) AS max
FROM lineitem GROUP BY l_returnflag""")
def box_plot(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    found = exact_quantiles(lines, F.col("l_extendedprice"), [0.0, 0.25, 0.5, 0.75, 1.0], ["l_returnflag"])
    rows = [(k[0], *v) for k, v in found.items()]
    stats = spark.createDataFrame(rows, "l_returnflag string, min double, q1 double, median double, q3 double, max double")
    return shown(frames.box_plot(stats, ["l_returnflag"]))


@query("""WITH c AS (SELECT 'p_brand' AS grouping_column, p_brand AS level, NULL::DOUBLE AS level_number, count(*) AS n FROM part GROUP BY p_brand
  UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), p_size, count(*) FROM part GROUP BY p_size),
r AS (SELECT *, row_number() OVER (PARTITION BY grouping_column ORDER BY n DESC, level_number NULLS FIRST, level) AS pos FROM c WHERE n >= 5)
SELECT grouping_column, level, n FROM r WHERE pos <= 12""")
def largest_groups(spark, sf_dir):
    """The twelve largest groups with five rows or more, of two grouping columns with many levels."""
    long = gs.long_groups(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand", "p_size"])
    return shown(gs.usable_levels(gs.level_moments(long), most_groups=12).select("grouping_column", "level", "n"))


@query("""WITH g AS (SELECT l_linestatus AS s, count(*)::DOUBLE AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1),
p AS (SELECT a.s AS level_a, b.s AS level_b, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, a.v AS va, b.v AS vb FROM g a, g b WHERE a.s < b.s)
SELECT 'l_linestatus' AS grouping_column, level_a, level_b, round((ma - mb) / sqrt(va / na + vb / nb), 4) AS t_statistic,
  round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 2) AS df, round(mb - ma, 4) AS mean_difference,
  round((mb - ma) / sqrt((va + vb) / 2), 4) AS cohens_d, round((mb / ma - 1) * 100, 2) + 0.0 AS lift_pct FROM p""")
def welch_t_statistic(spark, sf_dir):
    long = gs.long_groups(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_linestatus"])
    t = gs.welch(gs.first_two_levels(gs.usable_levels(gs.level_moments(long))))
    t = t.withColumn("lift_pct", lift_percent(F.col("mean_a"), F.col("mean_b"))).withColumn("df", F.round("df", 2))
    return shown(t.select("grouping_column", "level_a", "level_b", "t_statistic", "df", "mean_difference", "cohens_d", "lift_pct"))


@query(f"""WITH {_LONG}, g AS (SELECT grouping_column, level, count(*)::DOUBLE AS n, avg(y) AS m, var_samp(y) * (count(*) - 1) AS ss FROM long GROUP BY 1, 2),
a AS (SELECT grouping_column, avg(y) AS gm, count(*)::DOUBLE AS total, skewness(y) * (count(*) - 2) / sqrt(count(*)::DOUBLE * (count(*) - 1)) AS skew FROM long GROUP BY 1),
s AS (SELECT grouping_column, total, skew, count(*) AS k, sum(n * (m - gm) ** 2) AS ssb, sum(ss) AS ssw FROM g JOIN a USING (grouping_column) GROUP BY 1, 2, 3)
SELECT grouping_column, round((ssb / (k - 1)) / (ssw / (total - k)), 4) AS f_statistic, k - 1 AS df_between, CAST(total - k AS BIGINT) AS df_within,
  round(ssb / (ssb + ssw), 4) AS eta_squared, round(skew, 4) + 0.0 AS skew FROM s""")
def anova_f_statistic(spark, sf_dir):
    f = gs.anova(gs.pooled_by("grouping_column", gs.usable_levels(gs.level_moments(_order_groups(spark, sf_dir)))))
    return shown(f.select("grouping_column", "f_statistic", "df_between", "df_within", "eta_squared", "skew"))


@query("""WITH long AS (SELECT 'l_linestatus' AS grouping_column, l_linestatus AS level, l_quantity AS y FROM lineitem
  UNION ALL SELECT 'l_returnflag', l_returnflag, l_quantity FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY grouping_column ORDER BY y) + (count(*) OVER (PARTITION BY grouping_column, y) - 1) / 2.0 AS rk,
  count(*) OVER (PARTITION BY grouping_column, y)::DOUBLE AS t FROM long),
tie AS (SELECT grouping_column, sum(t * t - 1) AS tie_term FROM r GROUP BY 1)
SELECT grouping_column, level, count(*) AS n, round(sum(rk), 4) AS rank_sum, round(tie_term, 4) AS tie_term FROM r JOIN tie USING (grouping_column) GROUP BY 1, 2, tie_term""")
def rank_sums(spark, sf_dir):
    """Mid-rank sums of heavily tied quantities by two grouping columns."""
    lines = table(spark, sf_dir, "lineitem")
    long = gs.long_groups(lines, "l_quantity", ["l_linestatus", "l_returnflag"])
    levels = gs.usable_levels(gs.level_moments(long))
    return shown(gs.rank_sums(long, levels, lines.count()))


@query("""WITH p AS (SELECT l_linenumber AS test, avg(l_tax) / (l_linenumber * l_linenumber) AS p_value FROM lineitem GROUP BY l_linenumber),
r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS pos, count(*) OVER () AS m FROM p)
SELECT CAST(test AS BIGINT) AS test, round(p_value, 6) AS p_value,
  round(max(least(1.0, (m - pos + 1) * p_value)) OVER (ORDER BY p_value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS p_value_adjusted FROM r""")
def holm_adjust(spark, sf_dir):
    """Holm correction of one p-like value per line number."""
    share = F.avg("l_tax") / (F.col("l_linenumber") * F.col("l_linenumber"))
    tests = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(share.alias("p_value"))
    return shown(gs.holm(tests.withColumnRenamed("l_linenumber", "test")), 6)


@query("""WITH t AS (SELECT o_totalprice AS y, o_orderpriority, o_orderstatus FROM orders), g AS (
  SELECT 'o_orderpriority' AS grouping_column, o_orderpriority AS level, y FROM t UNION ALL SELECT 'o_orderstatus', o_orderstatus, y FROM t),
a AS (SELECT grouping_column, avg(y) AS gm, count(*)::DOUBLE AS total FROM g GROUP BY 1),
l AS (SELECT grouping_column, level, count(*) AS n, avg(y) AS m, var_samp(y) * (count(*) - 1) AS ss FROM g GROUP BY 1, 2)
SELECT grouping_column, 'anova' AS test, CAST(count(*) AS BIGINT) AS n_groups,
  round((sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(ss) / (total - count(*))), 4) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS df, total - count(*) AS df_within
FROM l JOIN a USING (grouping_column) GROUP BY 1, total""")
def hypothesis_report(spark, sf_dir):
    """The whole report on orders (role detection, statistics, ranks, Holm); its test statistics."""
    report = hy.run_hypotheses(table(spark, sf_dir, "orders"), "o_totalprice")
    return shown(report.tests.select("grouping_column", "test", "n_groups", "statistic", "df", "df_within"))


@query()
def hypothesis_p_values(spark, sf_dir):
    """p-values, corrections and robustness of every grouping column of lineitem."""
    report = hy.run_hypotheses(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return shown(report.tests, 6)


@query("""WITH g AS (SELECT l_returnflag = 'R' AS promo, avg(l_extendedprice) AS m FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT 'promo' AS grouping_column, round((max(m) FILTER (promo) / max(m) FILTER (NOT promo) - 1) * 100, 2) + 0.0 AS lift_pct, 38.7::DOUBLE AS expected_pct,
  abs((max(m) FILTER (promo) / max(m) FILTER (NOT promo) - 1) * 100 - 38.7) <= 2 AS within_tolerance FROM g""")
def promo_lift_parity(spark, sf_dir):
    """Lift of a two-level flag on open lines against an expected lift."""
    rows = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(
        "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("promo")
    )
    report = hy.run_hypotheses(rows, "l_extendedprice", ["promo"])
    return shown(hy.lift_parity(report, 38.7, 2.0).select("grouping_column", "lift_pct", "expected_pct", "within_tolerance"))


# ---------------------------------------------------------------- metrics


@query("""WITH e AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
SELECT l_returnflag, round(sqrt(avg(CASE WHEN y <> 0 THEN ((y - p) / y) ** 2 END)), 4) AS rmspe, round(avg(abs(y - p)), 4) AS mae,
  round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 4) AS r2, count(*) AS n,
  count(*) FILTER (y = 0) AS n_zero_actuals FROM e GROUP BY 1""")
def regression_metrics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_quantity") * 1500).alias("p"))
    return shown(metrics.regression_metrics(lines, "l_extendedprice", "p", ["l_returnflag"]))


_NAIVE_SQL = f"""{PANEL_GRID_SQL}, s AS (SELECT store_id, date, y, lag(y, 1) OVER o AS a, lag(y, 7) OVER o AS b FROM grid WINDOW o AS (PARTITION BY store_id ORDER BY date)),
p AS (SELECT store_id, date, y, 'last' AS model, a AS prediction FROM s WHERE b IS NOT NULL UNION ALL SELECT store_id, date, y, 'weekday', b FROM s WHERE b IS NOT NULL)"""
_DEMAND_SQL = """round(coalesce(sqrt(avg(CASE WHEN y >= 50 THEN ((y - prediction) / y) ** 2 END)) * 100, 0), 4) AS rmspe,
  round(avg(abs(y - prediction)), 4) AS mae, round(sqrt(avg((y - prediction) ** 2)), 4) AS rmse,
  round(1 - sum((y - prediction) ** 2) / (var_pop(y) * count(*)), 4) AS r2, count(*) AS n"""


def _naive_predictions(spark, sf_dir):
    from millrace.operators.lagging import series_features

    panel = store_days(spark, sf_dir).select("store_id", F.col("date").alias("period"), F.col("units_sold").alias("y"))
    dense = grid.fill_zero(grid.dense_grid(panel, "D", ["store_id"]), ["y"])
    wide = series_features(dense, "y", "D", (1, 7), (), (), ["store_id"]).where("lag_7 IS NOT NULL")
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("prediction")) for m, c in (("last", "lag_1"), ("weekday", "lag_7"))])
    return wide.select("store_id", "period", "y", F.inline(models))


@query(f"WITH {_NAIVE_SQL} SELECT model, {_DEMAND_SQL} FROM p GROUP BY model")
def rmspe_threshold(spark, sf_dir):
    return shown(metrics.demand_metrics(_naive_predictions(spark, sf_dir), "y", "prediction", ["model"]))


@query(f"WITH {_NAIVE_SQL} SELECT model, CASE WHEN y < 50 THEN 'y < 50' ELSE 'y >= 50' END AS slice, {_DEMAND_SQL} FROM p GROUP BY 1, 2")
def sliced_metrics(spark, sf_dir):
    return shown(metrics.sliced_metrics(_naive_predictions(spark, sf_dir)))


@query(f"""WITH {_NAIVE_SQL} SELECT CAST(store_id AS BIGINT) AS store_id, strftime(date, '%Y-%m-%d') AS period, y, model, prediction,
  prediction - y AS error, round(abs(prediction - y) / nullif(y, 0) * 100, 4) AS error_pct FROM p WHERE y < 50""")
def low_demand_detail(spark, sf_dir):
    return shown(metrics.low_demand_detail(_naive_predictions(spark, sf_dir)))


@query("""WITH j AS (SELECT lang, toxic = 1 AS t, n_chars > 2000 AS f FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (t AND f) AS tp, count(*) FILTER (NOT t AND f) AS fp, count(*) FILTER (t AND NOT f) AS fn,
  count(*) FILTER (NOT t AND NOT f) AS tn FROM j GROUP BY lang)
SELECT lang, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM c""")
def confusion_metrics(spark, sf_dir):
    """Document length as a detector of the toxic label, per language."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 2000).alias("flagged"))
    judged = documents.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return shown(metrics.confusion(judged, "toxic", "flagged", ["lang"]))


@query("""WITH j AS (SELECT toxic = 1 AS t, n_chars AS s FROM documents JOIN labels USING (doc_id)),
r AS (SELECT t, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk, s FROM j),
n AS (SELECT count(*) FILTER (t)::DOUBLE AS p, count(*) FILTER (NOT t)::DOUBLE AS q, quantile_cont(s::DOUBLE, 0.95) AS cut FROM r),
v AS (SELECT s, count(*) FILTER (t) AS hits, count(*) AS n FROM j GROUP BY s),
c AS (SELECT s, sum(hits) OVER w / (SELECT p FROM n) AS recall, sum(hits) OVER w / sum(n) OVER w AS prec FROM v WINDOW w AS (ORDER BY s DESC)),
a AS (SELECT sum((recall - coalesce(before, 0)) * (prec + coalesce(last, prec)) / 2) AS area
  FROM (SELECT recall, prec, lag(recall) OVER (ORDER BY s DESC) AS before, lag(prec) OVER (ORDER BY s DESC) AS last FROM c))
SELECT (SELECT round(area, 4) FROM a) AS pr_auc, round((sum(rk) FILTER (t) - p * (p + 1) / 2) / (p * q), 4) AS roc_auc,
  round(count(*) FILTER (t AND s >= cut) / p, 4) AS recall_top_5 FROM r, n GROUP BY p, q, cut""")
def score_curves(spark, sf_dir):
    """ROC and precision-recall areas, and recall in the top 5 %, of a score (document length against the toxic label)."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    judged = documents.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").persist()
    areas = metrics.curve_areas(judged, "toxic", "score")
    row = (float(areas["pr_auc"]), float(areas["roc_auc"]), float(metrics.top_share_recall(judged, "toxic", "score")))
    judged.unpersist()
    return shown(spark.createDataFrame([row], "pr_auc double, roc_auc double, recall_top_5 double"))


@query("""SELECT lang, count(*) AS kept, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY lang""")
def anomaly_exclusion_join(spark, sf_dir):
    """Documents without those labelled toxic; unlabelled ones stay."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    clean = metrics.exclude_anomalies(documents, table(spark, sf_dir, "labels"), "doc_id", "toxic")
    return shown(clean.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_chars").alias("chars")))


