"""Queries on parts that a fit or a folder usually hides: scans of written files, landing rules, projections, cluster steps, gates and bands.

Each takes its input from the tables, so that SQL can restate the part alone.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.catalog.registry import query, shown
from millrace.catalog.views import LOG_SQL, PANEL_GRID_SQL, PANEL_SQL, store_days, table, transaction_log
from millrace.operators import clusters, forest, frames, grid, hygiene, matrix, metrics
from millrace.plans import anomaly, forecast as fc, panel_training as pt, segmentation as sg
from millrace.session import shared_folder
from millrace.sources import landing, sinks, tables


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{os.urandom(8).hex()}-{name}"


# ---------------------------------------------------------------- scans of written files


@query("SELECT doc_id, 'é' || coalesce(lang, '') || '\"ü;' AS label, source, n_chars FROM documents")
def delimited_scan(spark, sf_dir):
    """Document rows through a semicolon file in Latin-1: encoding, delimiter, quotes and types are found again."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("é"), F.coalesce("lang", F.lit("")), F.lit('"ü;')).alias("label"), "source", "n_chars")
    path = _fresh(spark, "documents.csv")
    rows.write.options(header=True, sep=";", encoding="ISO-8859-1", quote='"', escape='"').csv(path)
    return shown(tables.read_table(spark, path))


@query("SELECT c_custkey, c_name, round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM customer")
def tab_scan(spark, sf_dir):
    """Customers through a tab-separated file."""
    path = _fresh(spark, "customer.tsv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.options(header=True, sep="\t").csv(path)
    return shown(tables.read_table(spark, path))


def _numbered(spark, sf_dir):
    return store_days(spark, sf_dir).withColumn("row_index", F.col("store_id").cast("bigint") * 100_000 + F.unix_date("date"))


_NUMBERED = PANEL_SQL + """, numbered AS (
  SELECT store_id, date, units_sold, CAST(store_id AS BIGINT) * 100000 + (date - DATE '1970-01-01') AS row_index FROM panel)"""


@query(f"WITH {_NUMBERED} SELECT store_id, strftime(date, '%Y-%m-%d') AS date, round(units_sold, 4) AS units_sold, row_index FROM numbered")
def panel_load(spark, sf_dir):
    """The store panel, stored with its dates as text and loaded with real dates."""
    path = _fresh(spark, "panel.parquet")
    sinks.write_parquet(_numbered(spark, sf_dir).withColumn("date", F.col("date").cast("string")), path)
    return shown(tables.load_panel(spark, path).select("store_id", "date", "units_sold", "row_index"))


@query(f"WITH {_NUMBERED} SELECT units_sold > 100 AS is_anomaly, count(*) AS rows, round(sum(units_sold), 4) AS units FROM numbered GROUP BY 1")
def labelled_load(spark, sf_dir):
    """Features and labels in files of their own, guarded against leaks, met by key."""
    rows = _numbered(spark, sf_dir)
    features, labels = _fresh(spark, "features.parquet"), _fresh(spark, "labels.parquet")
    sinks.write_parquet(rows, features)
    sinks.write_parquet(rows.select("row_index", (F.col("units_sold") > 100).alias("is_anomaly")), labels)
    x, y = tables.load_labelled(spark, features, labels)
    return shown(x.join(y, "row_index").groupBy("is_anomaly").agg(F.count(F.lit(1)).alias("rows"), F.sum("units_sold").alias("units")))


@query("""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS w, regr_intercept(l_extendedprice, l_quantity) AS b, avg(l_extendedprice) AS p FROM lineitem)
SELECT kind, round(w, 4) AS weight, round(b, 4) AS intercept, round(p, 4) AS mean_prediction FROM m, (SELECT unnest(['pipeline', 'table']) AS kind)""")
def model_store(spark, sf_dir):
    """A line through price by quantity, stored as a pipeline and as a table, loaded, and applied to all rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    ready = clusters.assemble(lines, ["l_quantity"])
    sinks.save_model(LinearRegression(labelCol="l_extendedprice", solver="normal").fit(ready), folder := _fresh(spark, "pipeline"))
    back = sinks.load_model(folder)
    sinks.save_linear({"line": matrix.pooled_ridge(lines, ["l_quantity"], "l_extendedprice", [0.0])[0.0]}, path := _fresh(spark, "line.parquet"), spark)
    line = sinks.load_linear(path, spark)["line"]
    fitted = back.stages[0]
    parts = [
        (back.transform(ready), "pipeline", float(fitted.coefficients[0]), float(fitted.intercept)),
        (line.predict(lines), "table", float(line.coefficients[0]), float(line.intercept)),
    ]
    rows = [
        p.agg(F.avg("prediction").alias("mean_prediction")).select(F.lit(k).alias("kind"), F.lit(w).alias("weight"), F.lit(b).alias("intercept"), "mean_prediction")
        for p, k, w, b in parts
    ]
    return shown(rows[0].unionByName(rows[1]))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS "'=key", n_name AS name, CAST(n_regionkey AS BIGINT) AS "'+name", n_name AS "'+name.1" FROM nation""")
def header_names(spark, sf_dir):
    """Header cells that a spreadsheet would run or that repeat a name."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", F.col("n_name").alias("again")).toDF("=key", "name", "+name", "'+name")
    return shown(hygiene.neutralise_formulas(rows))


# ---------------------------------------------------------------- landing rules

_LIMITS = landing.Limits(file_bytes=20_000, line_bytes=4_000, columns=8, parquet_rows=400)
_BARE = "replace(coalesce(text, ''), '\"', '')"
_KINDS = [  # name, content before, content after, declared type; the text of the document is in between
    ("d.csv", "a,b\\n", "", None), ("d.csv", "h,", "", None), ("d.txt", "", "", None), ("noext", "x", "", None), ("d.exe", "x", "", None),
    ("d%00.csv", "x", "", None), ("d.csv", "x", "", "application/pdf"), ("d.csv", "MZ", "", None), ("d.parquet", "x", "", None),
    ("d.parquet", "PAR1", "PAR1", None), ("d.parquet", "PAR1", "x", None), ("d.txt", "x", "NUL", None), ("d.tsv", 'a\\t"b\\n', "", None),
    ("d.csv", "a,b\\n", "", "text/csv; charset=utf-8"), ("d.csv", "#!", "", None), ("d.pdf", "%PDF-", "", None),
]


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\n", "' || chr(10) || '").replace("\\t", "' || chr(9) || '").replace("NUL", "") + "'"


def _by_kind(values: list[str]) -> str:
    return "CASE doc_id % 16 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_FILES_SQL = f"""files AS (SELECT doc_id, doc_id % 16 AS kind, n_chars, {_by_kind([f"'{n}'" for n, *_ in _KINDS])} AS name,
  {_by_kind(["''" if n == "d.txt" and not b else f"{_sql_text(b)} || {_BARE} || {_sql_text(a)}" for n, b, a, _ in _KINDS])} AS content FROM documents),
facts AS (SELECT *, strlen(content) + CASE WHEN kind = 11 THEN 1 ELSE 0 END AS length, CASE WHEN contains(name, '.') THEN split_part(name, '.', -1) ELSE '' END AS extension,
  CASE WHEN contains(name, '.csv') OR contains(name, '.tsv') THEN list_max(list_transform(string_split(content, chr(10)), lambda x: strlen(x))) END AS longest,
  len(string_split(split_part(content, chr(10), 1), CASE WHEN kind = 12 THEN chr(9) ELSE ',' END)) AS fields FROM files),
judged AS (SELECT *, CASE WHEN length > 20000 THEN '413 file too large' WHEN length = 0 THEN '422 empty file' WHEN kind = 5 THEN '415 null byte in file name'
  WHEN kind = 3 THEN '415 no extension' WHEN kind IN (4, 15) THEN '415 extension not allowed' WHEN kind = 6 THEN '415 declared type disagrees with extension'
  WHEN kind = 7 THEN '415 signature of Windows executable' WHEN kind = 14 THEN '415 signature of script' WHEN kind = 8 THEN '415 not a parquet file'
  WHEN kind = 10 THEN '422 corrupted Parquet file' WHEN kind = 11 THEN '415 null byte in text' WHEN longest > 4000 THEN '413 line too long'
  WHEN kind = 12 THEN '422 malformed header' WHEN extension IN ('csv', 'tsv') AND fields > 8 THEN '422 too many columns'
  WHEN kind = 9 AND n_chars > 400 THEN '413 too many Parquet rows' ELSE '200 ok' END AS verdict FROM facts)"""


@query(f"""WITH {_FILES_SQL} SELECT doc_id, name, extension, length, verdict = '200 ok' AS accepted, CAST(verdict[1:3] AS BIGINT) AS status, verdict[5:] AS reason FROM judged""")
def landing_rules(spark, sf_dir):
    """Every landing rule on file records made of the documents, sixteen kinds of files in turn."""
    kind = F.col("doc_id") % len(_KINDS)
    text = F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit(""))

    def pick(values):
        chain = F.when(kind == 0, values[0])
        for i, v in enumerate(values[1:], 1):
            chain = chain.when(kind == i, v)
        return chain

    def plain(t):
        return F.lit(t.replace("\\n", "\n").replace("\\t", "\t").replace("NUL", "\x00"))

    contents = [F.lit("") if n == "d.txt" and not b else F.concat(plain(b), text, plain(a)) for n, b, a, _ in _KINDS]
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", pick([F.lit(n) for n, *_ in _KINDS]).alias("name"), pick(contents).alias("content"), pick([F.lit(m) for *_, m in _KINDS]).alias("mime"))
    lines = F.array_max(F.transform(F.split("content", "\n"), F.octet_length))
    files = rows.select(
        F.concat_ws("/", F.lit("land"), F.col("doc_id").cast("string"), "name").alias("path"), F.octet_length("content").cast("bigint").alias("length"),
        F.encode("content", "UTF-8").alias("content"), "mime", F.when(F.col("name").rlike(r"\.[ct]sv$"), lines).alias("longest_line"), F.col("n_chars").alias("parquet_rows"),
    )
    found = landing.judge(files, _LIMITS)
    return shown(found.select(F.split("path", "/")[1].cast("bigint").alias("doc_id"), "name", "extension", "length", "accepted", "status", "reason"))


# ---------------------------------------------------------------- segments


def _logged(name: str) -> str:
    return f"CASE WHEN (SELECT skewness({name}) FROM g) > 1.5 THEN ln(1 + greatest(0, {name})) ELSE {name} END"


@query(f"""WITH {LOG_SQL}, lines AS (
  SELECT CAST(o_custkey AS VARCHAR) AS cid, inv, ts, qty * price AS amount, (inv LIKE 'C%' OR qty < 0) AS ret
  FROM log JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey IS NOT NULL AND o_custkey <> 0),
g AS (SELECT cid, CAST(floor(epoch((SELECT max(ts) FROM lines) + INTERVAL 1 DAY - max(ts)) / 86400) AS DOUBLE) AS r, CAST(count(DISTINCT inv) AS DOUBLE) AS f,
  coalesce(sum(amount) FILTER (amount > 0), 0.0) AS m, avg(CASE WHEN ret THEN 1.0 ELSE 0.0 END) AS q FROM lines GROUP BY cid)
SELECT cid AS "CustomerID", round({_logged("r")}, 4) AS recency, round({_logged("f")}, 4) AS frequency, round(ln(1 + m), 4) AS money, round({_logged("q")}, 4) AS returns FROM g""")
def customer_features(spark, sf_dir):
    """The model features of customers, skewed ones as logarithms."""
    found = sg.segment_features(transaction_log(spark, sf_dir, customers=True))
    names = dict(zip(found.names, ("recency", "frequency", "money", "returns")))
    return shown(found.frame.select("CustomerID", *[F.col(f"`feature:{n}`").alias(a) for n, a in names.items()]))


@query("""WITH m AS (SELECT avg(l_quantity) AS q, avg(l_extendedprice / 1000) AS p FROM lineitem),
x AS (SELECT l_orderkey, l_linenumber, l_quantity - q AS x, l_extendedprice / 1000 - p AS y FROM lineitem, m),
c AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM x),
t AS (SELECT 0.5 * atan2(2 * b, a - d) AS t, sqrt(((a - d) / 2) ** 2 + b ** 2) / ((a + d) / 2) AS e FROM c),
v AS (SELECT e, cos(t) AS u1, sin(t) AS u2, -sin(t) AS w1, cos(t) AS w2 FROM t),
s AS (SELECT *, sign(CASE WHEN abs(u1) >= abs(u2) THEN u1 ELSE u2 END) AS su, sign(CASE WHEN abs(w1) >= abs(w2) THEN w1 ELSE w2 END) AS sw FROM v)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(su * (u1 * x + u2 * y), 4) + 0.0 AS pca_x, round(sw * (w1 * x + w2 * y), 4) + 0.0 AS pca_y,
  round((1 + e) / 2, 4) AS share_1, round((1 - e) / 2, 4) AS share_2 FROM x, s""")
def two_components(spark, sf_dir):
    """Quantity and price of the line items on their principal axes, with the share of the variance that each explains."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    facts = matrix.column_facts(lines, ["x", "y"])
    ready = clusters.assemble(lines.withColumns({c: F.col(c) - f.mean for c, f in facts.items()}), ["x", "y"])
    flat, shares = clusters.project_2d(ready, ready)
    return shown(flat.select("l_orderkey", "l_linenumber", (F.round("pca_x", 4) + 0.0).alias("pca_x"), (F.round("pca_y", 4) + 0.0).alias("pca_y"), F.lit(shares[0]).alias("share_1"), F.lit(shares[1]).alias("share_2")))


@query("""WITH s AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey % 3 AS c FROM supplier),
d AS (SELECT a.id, a.c, b.c AS o, sum(abs(a.x - b.x)) AS total, count(*) AS n FROM s a JOIN s b ON TRUE GROUP BY 1, 2, 3),
w AS (SELECT id, max(CASE WHEN o = c THEN total / greatest(n - 1, 1) END) AS i, max(CASE WHEN o = c THEN n END) AS own, min(CASE WHEN o <> c THEN total / n END) AS e FROM d GROUP BY 1)
SELECT round(avg(CASE WHEN own > 1 AND greatest(i, e) > 0 THEN (e - i) / greatest(i, e) ELSE 0 END), 4) + 0.0 AS silhouette FROM w""")
def supplier_silhouette(spark, sf_dir):
    """Euclidean silhouette of three groups of nations by account balance; up to 4 096 suppliers a group it is exact."""
    rows = table(spark, sf_dir, "supplier").select("s_acctbal", (F.col("s_nationkey") % 3).alias("cluster"))
    found = clusters.silhouette(clusters.assemble(rows, ["s_acctbal"]).select("features", "cluster"), rows=4096)
    return shown(spark.range(1).select((F.round(F.lit(found.value), 4) + 0.0).alias("silhouette")))


_CENTRES = (((5.0, 10.0), (40.0, 50.0)), ((5.0, 5.0), (25.0, 30.0), (45.0, 80.0)))


@query("""WITH x AS (SELECT l_quantity AS q, l_extendedprice / 1000 AS p FROM lineitem),
c AS (SELECT * FROM (VALUES """ + ", ".join(f"({s}, {k}, {a}::DOUBLE, {b}::DOUBLE)" for s, own in enumerate(_CENTRES) for k, (a, b) in enumerate(own)) + """) c(run, cluster, a, b)),
g AS (SELECT run, q, p, min(struct_pack(gap := (q - a) ** 2 + (p - b) ** 2, cluster := cluster)) AS best FROM x, c GROUP BY run, q, p),
n AS (SELECT q, p, count(*) AS n FROM x GROUP BY 1, 2)
SELECT CAST(run AS BIGINT) AS run, CAST(best.cluster AS BIGINT) AS cluster, CAST(sum(n) AS BIGINT) AS n, round(sum(n * best.gap), 2) AS cost, round(sum(n * q) / sum(n), 4) AS quantity, round(sum(n * p) / sum(n), 4) AS price
FROM g JOIN n USING (q, p) GROUP BY 1, 2""")
def centre_step(spark, sf_dir):
    """One step of two runs of K-Means side by side: sizes, costs and new centres of all line items."""
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    rows = clusters.assemble(lines, ["l_quantity", "price"]).select(vector_to_array("features").alias("x"))
    found = clusters.centre_sums(rows, [np.array(c) for c in _CENTRES])
    return shown(found.select(
        F.col("at").alias("run"), "cluster", F.col("n").cast("bigint").alias("n"), F.round("cost", 2).alias("cost"), (F.col("total")[0] / F.col("n")).alias("quantity"), (F.col("total")[1] / F.col("n")).alias("price"),
    ))


# ---------------------------------------------------------------- anomalies, gates and bands


@query(f"""WITH {PANEL_SQL}, s AS (SELECT *, avg(units_sold) OVER w AS m, stddev_samp(units_sold) OVER w AS sd FROM panel WINDOW w AS (PARTITION BY store_id)),
f AS (SELECT units_sold > (SELECT quantile_cont(units_sold, 0.948) FROM panel) AS flagged, coalesce(units_sold > m + 1.5 * sd, false) AS truth FROM s),
c AS (SELECT count(*) FILTER (truth AND flagged) AS tp, count(*) FILTER (NOT truth AND flagged) AS fp, count(*) FILTER (truth AND NOT flagged) AS fn, count(*) FILTER (NOT truth AND NOT flagged) AS tn FROM f),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS q, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM c)
SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives, round(p, 4) AS precision, round(q, 4) AS recall, round(f1, 4) AS f1,
  q >= 0.9 AND (p >= 0.8 OR f1 >= 0.85) AS passes FROM r""")
def flagged_days(spark, sf_dir):
    """Days over the 94.8 % quantile of units, judged by key on labels kept apart (1.5 deviations over the store's mean)."""
    rows = _numbered(spark, sf_dir)
    stats = rows.groupBy("store_id").agg(F.avg("units_sold").alias("m"), F.stddev_samp("units_sold").alias("sd"))
    labels = rows.join(stats, "store_id").select("row_index", F.coalesce(F.col("units_sold") > F.col("m") + 1.5 * F.col("sd"), F.lit(False)).alias("is_anomaly"))
    scored, _ = forest.flag_outliers(rows.select("row_index", F.col("units_sold").cast("double").alias("anomaly_score")), anomaly.CONTAMINATION)
    return shown(anomaly.evaluate(scored, labels))


_NAIVE = PANEL_GRID_SQL + """, f AS (SELECT store_id, date, y, lag(y, 1) OVER w AS a, lag(y, 7) OVER w AS b FROM grid WINDOW w AS (PARTITION BY store_id ORDER BY date)),
long AS (SELECT store_id, 'boosted' AS model, y, a AS p FROM f WHERE b IS NOT NULL UNION ALL SELECT store_id, 'ridge', y, b FROM f WHERE b IS NOT NULL)"""


def _naive_rows(spark, sf_dir):
    """Yesterday's value in the place of the boosted model, that of a week ago in the place of ridge."""
    panel = store_days(spark, sf_dir).select("store_id", F.col("date").alias("period"), F.col("units_sold").alias("y"))
    dense = grid.fill_zero(grid.dense_grid(panel, "D", ["store_id"]), ["y"])
    order = Window.partitionBy("store_id").orderBy("period")
    wide = dense.select("store_id", F.col("y").cast("double").alias("y"), F.lag("y", 1).over(order).cast("double").alias("a"), F.lag("y", 7).over(order).cast("double").alias("b")).where("b IS NOT NULL")
    entries = F.array(F.struct(F.lit("boosted").alias("model"), F.col("a").alias("prediction")), F.struct(F.lit("ridge").alias("model"), F.col("b").alias("prediction")))
    return wide.select("store_id", "y", F.inline(entries))


@query(f"""WITH {_NAIVE}, m AS (SELECT store_id, model, sqrt(avg(CASE WHEN y <> 0 THEN ((y - p) / y) ** 2 END)) * 100 AS e,
  1 - sum((y - p) ** 2) / nullif(var_pop(y) * count(*), 0) AS r2 FROM long GROUP BY 1, 2)
SELECT model, count(*) AS series, round(avg(e), 4) AS mean_rmspe_pct, round(avg(r2), 4) AS mean_r2, bool_and(coalesce(e <= 20, false)) AS all_meet_gate FROM m GROUP BY 1""")
def store_gates(spark, sf_dir):
    """The store-level gate and its summary on naive forecasts."""
    found = metrics.regression_metrics(_naive_rows(spark, sf_dir), "y", "prediction", ["store_id", "model"])
    return shown(fc.gate_summary(fc.gate_rows(found)))


@query(f"""WITH {_NAIVE}, m AS (SELECT model, coalesce(sqrt(avg(CASE WHEN y >= 50 THEN ((y - p) / y) ** 2 END)) * 100, 0) AS e,
  1 - sum((y - p) ** 2) / nullif(var_pop(y) * count(*), 0) AS r2 FROM long GROUP BY 1),
g AS (SELECT max(e) FILTER (model = 'boosted') AS e, max(r2) FILTER (model = 'boosted') AS r2, max(e) FILTER (model = 'ridge') AS o FROM m)
SELECT round(e, 4) AS rmspe, round(r2, 4) AS r2, round(o, 4) AS ridge_rmspe, e <= 15 AS rmspe_ok, r2 >= 0.85 AS r2_ok, e < o AS beats_ridge, e <= 15 AND r2 >= 0.85 AND e < o AS passes FROM g""")
def naive_gates(spark, sf_dir):
    """The hard gates of pooled training on naive forecasts."""
    return shown(pt.gates(metrics.demand_metrics(_naive_rows(spark, sf_dir), "y", "prediction", ["model"])))


@query(f"""WITH {PANEL_GRID_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY date DESC) AS back, max(date) OVER (PARTITION BY store_id) AS last,
  sqrt(avg(y * y) OVER (PARTITION BY store_id)) AS e FROM grid)
SELECT store_id, strftime(date, '%Y-%m-%d') AS period, round(y, 4) AS actual, NULL::DOUBLE AS forecast, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM r WHERE back <= 365
UNION ALL SELECT store_id, strftime(last + CAST(15 - back AS INTEGER), '%Y-%m-%d'), NULL, round(y, 4), round(greatest(0, y - 1.96 * e), 4), round(y + 1.96 * e, 4) FROM r WHERE back <= 14""")
def naive_bands(spark, sf_dir):
    """Recent history, and the last fortnight repeated as a forecast with its band, in one frame for the chart."""
    panel = store_days(spark, sf_dir).select("store_id", F.col("date").alias("period"), F.col("units_sold").alias("y"))
    dense = grid.fill_zero(grid.dense_grid(panel, "D", ["store_id"]), ["y"]).select("store_id", "period", F.col("y").cast("double").alias("y"))
    error = dense.groupBy("store_id").agg(F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("rmse"), F.max("period").alias("last_period"))
    recent = frames.recent(dense, ["store_id"], n=14).groupBy("store_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("period", "y"))), lambda s: s["y"]).alias("path"))
    paths = recent.join(error, "store_id").withColumns({"selected": F.lit("naive"), "nonneg": F.lit(True)})
    return shown(frames.forecast_band_rows(frames.recent(dense, ["store_id"]), fc.band(paths, "D", ["store_id"]), "y", ["store_id"]))
