"""Queries on table profiles, hygiene, column roles, distributions and report frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query, shown
from millrace.catalog.views import PANEL_SQL, labelled_documents, store_days, table
from millrace.functions.values import log_ratio, quoted, rounded
from millrace.operators import frames, hygiene, matrix, metrics, profile, roles
from millrace.operators.order_stats import exact_quantiles
from millrace.sources import landing

_LABELLED = "l AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


@query(f"WITH {_LABELLED}, n AS (SELECT count(*) AS t FROM l) " + _union(
    f"SELECT {i}::BIGINT AS position, '{c}' AS column_name, t - count({c}) AS null_count, round((t - count({c})) * 100.0 / t, 2) AS null_percentage,"
    f" t AS total_rows FROM l, n GROUP BY t"
    for i, c in enumerate(("doc_id", "lang", "source", "n_chars", "quality", "toxic"))
))
def null_profile(spark, sf_dir):
    return shown(profile.null_profile(labelled_documents(spark, sf_dir)))


@query(f"""WITH {_LABELLED}, m AS (SELECT median(quality) AS q, median(toxic) AS t FROM l)
SELECT doc_id, lang, source, n_chars, round(coalesce(quality, q), 4) AS quality, round(coalesce(toxic, t), 4) AS toxic,
  quality IS NULL AS quality_was_missing, toxic IS NULL AS toxic_was_missing FROM l, m""")
def impute_with_indicator(spark, sf_dir):
    return shown(hygiene.impute_for_models(labelled_documents(spark, sf_dir)))


_WORDS = "('true', 'false', 't', 'f', 'yes', 'no')"


def _text_type_sql(view: str, c: str) -> str:
    dated = rf"CASE WHEN length({c}) <= 100 AND regexp_matches({c}, '\d[-/.:]\d') AND TRY_CAST({c} AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END"
    return (
        f"SELECT '{c}' AS column_name, CASE WHEN count({c}) = 0 THEN 'text' WHEN max(length({c})) > 100 THEN 'text'"
        f" WHEN bool_and(lower(trim({c})) IN {_WORDS}) THEN 'boolean' WHEN avg({dated}) > 0.8 THEN 'datetime'"
        f" WHEN avg(length({c})) > 50 OR (avg(length({c})) > 20 AND count(DISTINCT {c}) > 0.5 * count({c}) AND bool_or(contains({c}, ' '))) THEN 'text'"
        f" WHEN count(DISTINCT {c}) <= 20 OR count(DISTINCT {c}) < 0.1 * count({c}) THEN 'categorical' ELSE 'text' END AS inferred_type"
        f" FROM {view} WHERE {c} IS NOT NULL"
    )


def _int_type_sql(view: str, c: str) -> str:
    return f"SELECT '{c}' AS column_name, CASE WHEN bool_and({c} IN (0, 1)) THEN 'boolean' ELSE 'numeric' END AS inferred_type FROM {view}"


@query(_union([
    _int_type_sql("events", "event_id"), "SELECT 'ts', 'datetime'", _int_type_sql("events", "user_id"),
    _text_type_sql("events", "event_type"), "SELECT 'value', 'numeric'", _text_type_sql("events", "props"),
]))
def type_profile(spark, sf_dir):
    return shown(profile.semantic_types(table(spark, sf_dir, "events")).drop("position"))


@query(_union([f"SELECT DISTINCT '{c}' AS column_name, 'datetime' AS inferred_type FROM events" for c in ("compact", "day_first", "slashes", "stamp", "words")]))
def type_profile_dates(spark, sf_dir):
    """Event times in five spellings; each reads as dates."""
    spellings = {"compact": "yyyyMMdd", "day_first": "dd/MM/yyyy", "slashes": "yyyy/MM/dd", "stamp": "dd/MM/yyyy HH:mm", "words": "d MMM yyyy"}
    events = table(spark, sf_dir, "events").select(*[F.date_format("ts", p).alias(c) for c, p in spellings.items()])
    return shown(profile.semantic_types(events).drop("position"))


@query("WITH n AS (SELECT count(*) AS t FROM documents), ty AS (" + _union([
    _int_type_sql("documents", "doc_id"), _text_type_sql("documents", "text"), _text_type_sql("documents", "lang"),
    _text_type_sql("documents", "source"), _int_type_sql("documents", "n_chars"),
]) + "), nu AS (" + _union(
    f"SELECT {i}::BIGINT AS position, '{c}' AS column_name, count(*) - count({c}) AS null_count FROM documents"
    for i, c in enumerate(("doc_id", "text", "lang", "source", "n_chars"))
) + """) SELECT column_name, position, null_count, round(null_count * 100.0 / t, 2) AS null_percentage, t AS total_rows,
  inferred_type, 5::BIGINT AS column_count FROM nu JOIN ty USING (column_name), n""")
def table_overview(spark, sf_dir):
    return shown(profile.table_overview(table(spark, sf_dir, "documents")))


@query("WITH " + ", ".join(
    f"{n} AS (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem)" for n, c in
    (("a", "l_orderkey"), ("b", "l_partkey"), ("c", "l_suppkey"))
) + " " + _union([
    f"SELECT '{c}' AS column_name, CASE WHEN lo >= -32768 AND hi < 32768 THEN 'smallint' WHEN lo >= -2147483648 AND hi < 2147483648"
    f" THEN 'int' ELSE 'bigint' END AS narrowed FROM {n}"
    for n, c in (("a", "l_orderkey"), ("b", "l_partkey"), ("c", "l_suppkey"))
] + [f"SELECT '{c}', 'float'" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]))
def downcast_types(spark, sf_dir):
    """The type each wide column of lineitem narrows to."""
    plan = hygiene.downcast_plan(table(spark, sf_dir, "lineitem"))
    return spark.createDataFrame([(c, t.simpleString()) for c, t in plan.items()], "column_name string, narrowed string")


@query(_union(f"SELECT '{c}' AS column_name, max(length({c})) AS longest FROM documents" for c in ("text", "lang", "source")))
def longest_cells(spark, sf_dir):
    return shown(hygiene.longest_cells(table(spark, sf_dir, "documents")))


_MARKED = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '=' WHEN 1 THEN '  @' WHEN 2 THEN '+' WHEN 3 THEN '＝-' WHEN 4 THEN chr(9) ELSE '' END || text AS cell
FROM documents"""


def _marked_documents(spark, sf_dir):
    """Whole documents with a formula mark put before most of them."""
    turn = F.col("doc_id") % 6
    mark = F.when(turn == 0, "=").when(turn == 1, "  @").when(turn == 2, "+").when(turn == 3, "＝-").when(turn == 4, "\t").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(mark, "text").alias("cell"))


_BLANK_SQL = r"[\s\x1c-\x1f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MARK_SQL = r"[=@+\-\t\r\n＝＠＋－]"


@query(f"WITH m AS ({_MARKED}) SELECT doc_id, CASE WHEN regexp_matches(cell, '^{_BLANK_SQL}*{_MARK_SQL}') THEN '''' || cell ELSE cell END AS cell FROM m")
def formula_quote(spark, sf_dir):
    return hygiene.neutralise_formulas(_marked_documents(spark, sf_dir), "quote")


@query(f"WITH m AS ({_MARKED}) SELECT doc_id, regexp_replace(cell, '^{_BLANK_SQL}*{_MARK_SQL}+', '') AS cell FROM m")
def formula_strip(spark, sf_dir):
    return hygiene.neutralise_formulas(_marked_documents(spark, sf_dir), "strip")


@query("""SELECT o_orderkey, CAST(o_orderstatus = 'O' AS BIGINT) AS "o_orderstatus_O", CAST(o_orderstatus = 'P' AS BIGINT) AS "o_orderstatus_P",
  CAST(o_orderpriority = '2-HIGH' AS BIGINT) AS "o_orderpriority_2-HIGH", CAST(o_orderpriority = '3-MEDIUM' AS BIGINT) AS "o_orderpriority_3-MEDIUM",
  CAST(o_orderpriority = '4-NOT SPECIFIED' AS BIGINT) AS "o_orderpriority_4-NOT SPECIFIED", CAST(o_orderpriority = '5-LOW' AS BIGINT) AS "o_orderpriority_5-LOW"
FROM orders""")
def one_hot_levels(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return shown(hygiene.one_hot(orders, hygiene.category_levels(orders, ["o_orderstatus", "o_orderpriority"])))


# ---------------------------------------------------------------- roles


@query("""WITH t AS (SELECT unnest([{'c': 'iso', 'v': strftime(o_orderdate, '%Y-%m-%d')}, {'c': 'day_first', 'v': strftime(o_orderdate, '%d-%m-%Y')},
  {'c': 'month_first', 'v': strftime(o_orderdate, '%m/%d/%Y')}]) AS e FROM orders),
p AS (SELECT e.c AS column_name, regexp_matches(e.v, '^\\d{4}-') AS iso,
  TRY_CAST(regexp_extract(e.v, '^(\\d{1,2})[-/](\\d{1,2})[-/]', 1) AS INTEGER) AS a,
  TRY_CAST(regexp_extract(e.v, '^(\\d{1,2})[-/](\\d{1,2})[-/]', 2) AS INTEGER) AS b FROM t)
SELECT column_name, (NOT bool_or(iso) AND max(a) > 12 AND max(b) <= 12) AS is_day_first,
  CASE WHEN bool_and(iso) THEN 'iso' WHEN max(a) > 12 AND max(b) > 12 THEN 'mixed' WHEN max(a) > 12 THEN 'day-first'
  WHEN max(b) > 12 THEN 'month-first' ELSE 'assumed month-first' END AS label FROM p GROUP BY column_name""")
def date_format_inference(spark, sf_dir):
    day = F.col("o_orderdate")
    texts = table(spark, sf_dir, "orders").select(
        F.date_format(day, "yyyy-MM-dd").alias("iso"), F.date_format(day, "dd-MM-yyyy").alias("day_first"),
        F.date_format(day, "MM/dd/yyyy").alias("month_first"),
    )
    rows = [(c, *roles.date_reading(texts, c)) for c in texts.columns]
    return spark.createDataFrame(rows, "column_name string, is_day_first boolean, label string")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS day_first, strftime(o_orderdate, '%Y-%m-%d') AS month_first FROM orders")
def date_parsing(spark, sf_dir):
    """Three spellings of the order date, each read back with its inferred reading."""
    day = F.col("o_orderdate")
    texts = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("iso"), F.date_format(day, "dd-MM-yyyy").alias("day_first"),
        F.date_format(day, "M/d/yyyy H:mm").alias("month_first"),
    )
    read = {c: roles.date_values(texts, c)[0] for c in ("iso", "day_first", "month_first")}
    return shown(texts.select("o_orderkey", *[v.alias(c) for c, v in read.items()]))


@query("""WITH t AS (SELECT strftime(o_orderdate, '%d-%m-%Y') AS "when", o_orderpriority AS priority, strftime(o_orderdate, '%Y/%m/%d') AS later FROM orders)
SELECT 'when' AS column_name, count(*) AS n, 0.0::DOUBLE AS iso_share, 1.0::DOUBLE AS triple_share FROM t UNION ALL SELECT 'priority', count(*), 0.0::DOUBLE, 0.0::DOUBLE FROM t
UNION ALL SELECT 'later', count(*), 1.0::DOUBLE, 0.0::DOUBLE FROM t""")
def date_column_shares(spark, sf_dir):
    day = F.col("o_orderdate")
    texts = table(spark, sf_dir, "orders").select(
        F.date_format(day, "dd-MM-yyyy").alias("when"), F.col("o_orderpriority").alias("priority"), F.date_format(day, "yyyy/MM/dd").alias("later")
    )
    return shown(roles.date_shares(texts, texts.columns))


_ID_TABLES = (("orders", ("o_orderkey", "o_custkey")), ("events", ("event_id", "user_id")), ("lineitem", ("l_orderkey", "l_linenumber")))


@query(_union(
    f"SELECT '{c}' AS column_name, (count(*) > 20 AND count({c}) = count(*) AND max({c}) - min({c}) + 1 = count(*) AND count(DISTINCT {c}) = count(*)) AS is_id FROM {t}"
    for t, cs in _ID_TABLES for c in cs
))
def id_columns(spark, sf_dir):
    rows = []
    for name, columns in _ID_TABLES:
        found = roles.id_columns(table(spark, sf_dir, name).select(*columns))
        rows += [(c, c in found) for c in columns]
    return spark.createDataFrame(rows, "column_name string, is_id boolean")


_LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query(_union(
    f"SELECT '{c}' AS column_name, (count(DISTINCT {c}) BETWEEN 2 AND 12{f' AND bool_and({c} = floor({c}))' if c in _LINE_COLUMNS[4:8] else ''}) AS is_category FROM lineitem"
    for c in _LINE_COLUMNS
))
def categorical_candidates(spark, sf_dir):
    found = roles.category_columns(table(spark, sf_dir, "lineitem"))
    return spark.createDataFrame([(c, c in found) for c in _LINE_COLUMNS], "column_name string, is_category boolean")


_LEAK_SQL = """t AS (SELECT l_extendedprice AS gross, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * l_discount AS rebate,
  l_extendedprice + 0.0 AS copy, 3 * l_extendedprice + 7 AS scaled, l_quantity AS quantity, l_tax AS tax FROM lineitem)"""


def _leaky(spark, sf_dir):
    price, off = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        price.alias("gross"), (price * (1 - off)).alias("net"), (price * off).alias("rebate"), (price + 0.0).alias("copy"),
        (price * 3 + 7).alias("scaled"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"),
    )


@query(f"WITH {_LEAK_SQL} " + _union(
    f"SELECT '{c}' AS column_name, count(*) AS n, bool_and(abs(gross - {c}) <= 1e-8 + 1e-5 * abs({c})) AS identical, round(corr({c}, gross), 4) AS r FROM t"
    for c in ("net", "rebate", "copy", "scaled", "quantity", "tax")
))
def leak_scores(spark, sf_dir):
    return shown(roles.leak_scores(_leaky(spark, sf_dir), "gross", ["net", "rebate", "copy", "scaled", "quantity", "tax"]))


_PAIRS = [(a, b) for i, a in enumerate(("net", "rebate", "quantity", "tax")) for b in ("net", "rebate", "quantity", "tax")[i + 1:]]


@query(f"WITH {_LEAK_SQL}, p AS (" + _union(
    f"SELECT '{a}' AS first_column, '{b}' AS second_column, bool_and(abs(gross - ({a} + {b})) <= 1e-8 + 1e-5 * abs({a} + {b})) AND count(*) > 5 AS hit FROM t"
    for a, b in _PAIRS
) + ") SELECT first_column, second_column FROM p WHERE hit")
def leak_pair_sum(spark, sf_dir):
    hits = roles.pair_sum_hits(_leaky(spark, sf_dir), "gross", ["net", "rebate", "quantity", "tax"])
    return spark.createDataFrame(hits, "first_column string, second_column string")


# ---------------------------------------------------------------- matrix and distributions

_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query(_union(
    f"SELECT '{c}' AS column_name, count({c}) AS n, round(skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1)), 4) + 0.0 AS skew_population,"
    f" round(skewness({c}), 4) + 0.0 AS skew_corrected FROM lineitem" for c in _NUMBERS
))
def skewness_by_column(spark, sf_dir):
    return shown(matrix.skewness_table(table(spark, sf_dir, "lineitem"), _NUMBERS))


@query("""WITH o AS (SELECT l_orderkey AS k, sum(l_quantity) * 1.0 AS quantity, exp(sum(l_discount) * 20) AS growth FROM lineitem GROUP BY l_orderkey),
s AS (SELECT skewness(quantity) AS a, min(quantity) AS la, skewness(growth) AS b, min(growth) AS lb FROM o)
SELECT k AS id, round(CASE WHEN a > 1.5 AND la > -1 THEN ln(1 + greatest(quantity, 0)) ELSE quantity END, 4) AS quantity,
  round(CASE WHEN b > 1.5 AND lb > -1 THEN ln(1 + greatest(growth, 0)) ELSE growth END, 4) AS growth FROM o, s""")
def skew_log1p(spark, sf_dir):
    """Log transform of right-skewed columns: per-order totals, one of them heavily skewed."""
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum("l_quantity").alias("quantity"), F.exp(F.sum("l_discount") * 20).alias("growth")
    )
    facts = matrix.column_facts(orders, ["quantity", "growth"])
    return shown(matrix.log_transform(orders, matrix.skewed_columns(facts)))


@query("WITH v AS (" + _union(f"SELECT '{c}' AS column_name, var_samp({c}) AS variance FROM lineitem" for c in _NUMBERS)
       + ") SELECT column_name, round(variance, 4) AS variance FROM v WHERE variance > 1e-12")
def variance_rank(spark, sf_dir):
    return shown(matrix.variance_table(table(spark, sf_dir, "lineitem"), _NUMBERS))


@query(_union(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 4) + 0.0 AS value FROM lineitem" if a != b else f"SELECT '{a}' AS x, '{b}' AS y, 1.0::DOUBLE AS value"
    for a in _NUMBERS for b in _NUMBERS
))
def correlation_matrix(spark, sf_dir):
    frame, _ = matrix.correlation_frame(table(spark, sf_dir, "lineitem"), _NUMBERS)
    return frame


@query(f"WITH {_LABELLED} SELECT 'n_chars' AS x, 'toxic' AS y, round(corr(n_chars, toxic), 4) + 0.0 AS value FROM l UNION ALL "
       "SELECT 'n_chars', 'quality', round(corr(n_chars, quality), 4) + 0.0 FROM l UNION ALL SELECT 'toxic', 'quality', round(corr(toxic, quality), 4) + 0.0 FROM l")
def correlation_with_gaps(spark, sf_dir):
    """Pairwise-complete correlations where two of three columns have NULLs."""
    frame, _ = matrix.correlation_frame(labelled_documents(spark, sf_dir), ["n_chars", "toxic", "quality"])
    pair = F.struct("x", "y")
    return frame.where(pair.isin(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in
                                   (("n_chars", "toxic"), ("n_chars", "quality"), ("toxic", "quality"))]))


@query("""WITH m AS (SELECT avg(c_acctbal) AS a, stddev_pop(c_acctbal) AS b, avg(c_nationkey) AS c, stddev_pop(c_nationkey) AS d FROM customer)
SELECT c_custkey, round((c_acctbal - a) / b, 4) + 0.0 AS c_acctbal, round((c_nationkey - c) / d, 4) + 0.0 AS c_nationkey FROM customer, m""")
def standardised(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return shown(matrix.standardise(rows, matrix.column_facts(rows, ["c_acctbal", "c_nationkey"])))


@query("""SELECT l_returnflag, unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS prob,
  unnest([round(quantile_cont(l_extendedprice, 0.05), 4), round(quantile_cont(l_extendedprice, 0.25), 4), round(quantile_cont(l_extendedprice, 0.5), 4),
  round(quantile_cont(l_extendedprice, 0.75), 4), round(quantile_cont(l_extendedprice, 0.95), 4)]) AS value FROM lineitem GROUP BY l_returnflag""")
def exact_quantiles_by_flag(spark, sf_dir):
    """Exact quantiles by bracket narrowing, forced by a low row limit for the direct form."""
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), probs, ["l_returnflag"], direct_rows=2000)
    rows = [(key[0], p, float(v)) for key, values in found.items() for p, v in zip(probs, values)]
    return shown(spark.createDataFrame(rows, "l_returnflag string, prob double, value double"))


@query(f"""WITH {PANEL_SQL} SELECT count(*) AS n, min(units_sold) AS min, max(units_sold) AS max, round(avg(units_sold), 4) AS mean,
  round(stddev_samp(units_sold), 4) AS sd, round(avg(CASE WHEN units_sold < 50 THEN 1.0 ELSE 0.0 END), 4) AS share_below_50,
  round(quantile_cont(units_sold, 0.05), 4) AS p5, round(quantile_cont(units_sold, 0.25), 4) AS p25, round(median(units_sold), 4) AS median,
  round(quantile_cont(units_sold, 0.75), 4) AS p75, round(quantile_cont(units_sold, 0.95), 4) AS p95,
  (median(units_sold) < 10 OR stddev_samp(units_sold) > median(units_sold)) AS low_magnitude FROM panel""")
def target_distribution(spark, sf_dir):
    return shown(metrics.target_distribution(store_days(spark, sf_dir), "units_sold"))


@query("""WITH r AS (SELECT unnest([{'f': 'l_quantity', 'r': corr(l_quantity, l_extendedprice)}, {'f': 'l_discount', 'r': corr(l_discount, l_extendedprice)},
  {'f': 'l_tax', 'r': corr(l_tax, l_extendedprice)}]) AS e FROM lineitem)
SELECT e.f AS feature, round(e.r, 4) + 0.0 AS r, (SELECT max(abs(e.r)) FROM r) < 0.1 AS all_weak FROM r""")
def correlation_ranking(spark, sf_dir):
    return shown(metrics.correlation_ranking(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))


# ---------------------------------------------------------------- report frames


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem),
b AS (SELECT least(19, CAST(floor((l_extendedprice - lo) / w) AS BIGINT)) AS bin, lo, w FROM lineitem, e)
SELECT bin, round(lo + bin * w, 4) AS lower, round(lo + (bin + 1) * w, 4) AS upper, count(*) AS count FROM b GROUP BY bin, lo, w""")
def histogram(spark, sf_dir):
    return shown(frames.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20))


@query("""SELECT CAST(event_id AS VARCHAR) AS record_id, round(value, 4) AS score, event_id, user_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts
FROM events ORDER BY value DESC, record_id LIMIT 100""")
def top_outliers(spark, sf_dir):
    """The report's 100 strangest events by value."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.col("value").alias("score"))
    return shown(frames.top_outliers(events, "score", fallback_id="event_id"))


@query("""WITH q AS (SELECT quantile_cont(value, 0.97) AS cut FROM events), f AS (SELECT value > cut AS is_outlier FROM events, q),
n AS (SELECT count(*) FILTER (is_outlier) AS o, count(*) FILTER (NOT is_outlier) AS i FROM f)
SELECT true AS is_outlier, o AS points FROM n UNION ALL SELECT false, least(i, greatest(0, 5000 - o)) FROM n""")
def scatter_cap(spark, sf_dir):
    """Scatter cap: every outlier stays, inliers fill the rest of 5000 points."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    cut = exact_quantiles(events, F.col("value"), [0.97]).get((), [None])[0]
    marked = events.withColumn("is_outlier", F.col("value") > F.lit(cut).cast("double"))
    points = frames.scatter_points(marked, cap=5000, id_col="event_id")
    # Both kinds have a row, also where outliers leave no room for the others.
    counts = points.agg(F.count_if("is_outlier").alias("outliers"), F.count_if(~F.col("is_outlier")).alias("inliers"))
    rows = [F.struct(F.lit(kind).alias("is_outlier"), F.col(name).alias("points")) for kind, name in ((True, "outliers"), (False, "inliers"))]
    return shown(counts.select(F.inline(F.array(*rows))))


@query(f"""WITH {PANEL_SQL}, p AS (SELECT *, lag(units_sold, 7) OVER (PARTITION BY store_id ORDER BY date) AS e FROM panel)
SELECT CAST(store_id AS BIGINT) AS store_id, strftime(date, '%Y-%m-%d') AS date, round(units_sold - e, 4) AS residual,
  round(ln((units_sold + 1) / (greatest(e, 1) + 1)), 4) + 0.0 AS log_ratio FROM p WHERE e IS NOT NULL""")
def contextual_residuals(spark, sf_dir):
    from pyspark.sql import Window

    expected = F.lag("units_sold", 7).over(Window.partitionBy("store_id").orderBy("date"))
    rows = store_days(spark, sf_dir).withColumn("e", expected).where("e IS NOT NULL")
    return shown(rows.select(
        "store_id", "date", (quoted("units_sold") - F.col("e")).alias("residual"), rounded(log_ratio(F.col("units_sold"), F.col("e"))).alias("log_ratio")
    ))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
           "benchmark", "labels", "conversations")


@query(_union(
    f"SELECT '{t}.parquet' AS name, count(*) <= 1000000 AS accepted, CASE WHEN count(*) <= 1000000 THEN 200::BIGINT ELSE 413 END AS status,"
    f" CASE WHEN count(*) <= 1000000 THEN 'ok' ELSE 'too many Parquet rows' END AS reason, count(*) AS parquet_rows FROM {t}"
    for t in _TABLES
))
def landing_audit(spark, sf_dir):
    """Admission audit of the table folder itself."""
    found = landing.audit(spark, sf_dir, limits=landing.UPLOAD)
    return shown(found.select("name", "accepted", "status", "reason", "parquet_rows"))
