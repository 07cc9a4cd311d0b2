import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import hygiene, matrix, order_stats, profile, roles


def test_null_profile(spark):
    df = spark.createDataFrame([(1.0, None, None), (None, "a", None), (float("nan"), "b", None)], "age double, dept string, gone double")
    got = {r["column_name"]: (r["null_count"], r["null_percentage"]) for r in profile.null_profile(df).collect()}
    assert got == {"age": (2, 66.67), "dept": (1, 33.33), "gone": (3, 100.0)}
    assert profile.null_profile(df.limit(0)).first()["null_percentage"] == 0.0


def test_semantic_types(spark):
    rows = [(1.5, 0, "a", "2024-01-01", "x" * 101, "yes", True, None, "12/25/2024"), (2.5, 1, "b", "2024-01-02", "short", "no", False, None, "1/2/2024")]
    df = spark.createDataFrame(rows, "num double, flag int, cat string, day string, long string, words string, bool boolean, none string, us string")
    got = {r["column_name"]: r["inferred_type"] for r in profile.semantic_types(df).collect()}
    assert got == {"num": "numeric", "flag": "boolean", "cat": "categorical", "day": "datetime", "long": "text", "words": "boolean",
                   "bool": "boolean", "none": "text", "us": "datetime"}


def test_unique_words_are_text_or_categories(spark):
    df = spark.range(200).select(F.concat(F.lit("some longer text no "), F.col("id")).alias("free"), (F.col("id") % 19).cast("string").alias("few"),
                                 F.concat(F.lit("k"), F.col("id")).alias("codes"))
    got = {r["column_name"]: r["inferred_type"] for r in profile.semantic_types(df).collect()}
    assert got == {"free": "text", "few": "categorical", "codes": "text"}
    overview = {r["column_name"]: r for r in profile.table_overview(df).collect()}
    assert overview["few"]["inferred_type"] == "categorical" and overview["few"]["total_rows"] == 200 and overview["few"]["column_count"] == 3


def test_imputation(spark):
    df = spark.createDataFrame([(25.0, None, "a", None), (None, 75000.0, None, None), (35.0, 75000.0, "b", None)], "age double, salary double, dept string, void double")
    out = hygiene.impute_for_models(df)
    rows = out.orderBy("age", "salary").collect()
    assert {r["age"] for r in rows} == {25.0, 30.0, 35.0} and {r["salary"] for r in rows} == {75000.0} and {r["void"] for r in rows} == {0.0}
    assert [c for c in out.columns if c.endswith("_was_missing")] == ["age_was_missing", "salary_was_missing", "dept_was_missing", "void_was_missing"]
    assert [r["dept"] for r in rows if r["dept_was_missing"]] == ["missing"]
    assert df.where("age IS NULL").count() == 1


def test_headers_and_cells(spark):
    assert hygiene.safe_headers(["=a", "x", "X", "x", "-b"]) == ["'=a", "x", "X.1", "x.2", "'-b"]
    assert hygiene.safe_headers(["=+a", " @b"], "strip") == ["a", "b"]
    out = hygiene.neutralise_formulas(spark.createDataFrame([("=1", -1)], "`a.b` string, n int"))
    assert out.columns == ["a.b", "n"] and tuple(out.first()) == ("'=1", -1)
    with pytest.raises(ValueError):
        hygiene.guard_cell_length(spark.createDataFrame([("abcd",)], "t string"), 3)


def test_downcast(spark):
    df = spark.createDataFrame([(1, 40000, 2**40, 1.5, 1e300, None)], "a long, b long, c long, d double, e double, f long")
    kinds = [f.dataType.simpleString() for f in hygiene.downcast(df).schema]
    assert kinds == ["smallint", "int", "bigint", "float", "double", "smallint"]


def test_one_hot_unknown_level(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    levels = hygiene.category_levels(train, ["k"])
    got = [tuple(r) for r in hygiene.one_hot(spark.createDataFrame([("a",), ("c",), ("z",), (None,)], "k string"), levels).collect()]
    assert levels == {"k": ["a", "b", "c"]} and got == [(0, 0), (0, 1), (0, 0), (0, 0)]


# ---------------------------------------------------------------- roles


def bikes(spark, days=730):
    start = pd.Timestamp("2011-01-01")
    rng = np.random.default_rng(1)
    rows = []
    for i in range(days):
        day = start + pd.Timedelta(days=i)
        casual, registered = int(rng.integers(100, 900)), int(rng.integers(1000, 4000))
        rows.append((i + 1, day.strftime("%d-%m-%Y"), day.quarter, float(rng.random()), float(casual), float(registered), float(casual + registered)))
    return spark.createDataFrame(rows, "instant int, dteday string, season int, temp double, casual double, registered double, cnt double").repartition(5)


def test_bike_roles(spark):
    df = bikes(spark)
    assert roles.date_column(df) == "dteday"
    assert roles.date_reading(df, "dteday") == (True, "day-first")
    assert roles.id_columns(df) == ["instant"]
    assert roles.forecast_target(df, {"instant"}) == "cnt"
    assert set(roles.target_leaks(df, "cnt", ["season", "temp", "casual", "registered"])) == {"casual", "registered"}
    assert roles.category_columns(df) == ["season"]


def test_counter_without_hint(spark):
    base = spark.range(30).select((F.col("id") + 7).alias("serial"), (F.col("id") % 5).alias("group"), (F.col("id") * 2).alias("even"))
    assert roles.id_columns(base) == ["serial"]
    ordered = base.withColumn("at", F.col("id") if "id" in base.columns else F.col("serial"))
    assert roles.id_columns(ordered, protect={"at"}, order_col="at") == ["serial"]
    assert roles.id_columns(base.withColumn("at", F.hash("serial")), protect={"at"}, order_col="at") == []
    assert roles.id_columns(base.limit(20)) == []


def test_date_readings(spark):
    def label(*values):
        return roles.date_reading(spark.createDataFrame([(v,) for v in values], "d string"), "d")

    assert label("2024-01-02") == (False, "iso")
    assert label("13/01/2024", "01/02/2024") == (True, "day-first")
    assert label("01/13/2024") == (False, "month-first")
    assert label("13/01/2024", "01/13/2024") == (False, "mixed")
    assert label("01/02/2024") == (False, "assumed month-first")
    assert label("n/a") == (False, "other")
    days = [(f"{d:02d}/01/2024", i) for i, d in enumerate(range(1, 13))]
    assert roles.date_reading(spark.createDataFrame(days, "d string, i int"), "d", "i") == (True, "day-first (inferred from order)")


def test_no_date_column(spark):
    with pytest.raises(roles.NoDateColumn):
        roles.date_column(spark.createDataFrame([(1, "x")], "a int, b string"))


def test_leaks_identical_and_scaled(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("y"), (F.col("id") * 1.0).alias("same"), (F.col("id") * 2.0 + 1).alias("scaled"),
                                (F.col("id") % 7).cast("double").alias("free"), F.lit(1.0).alias("flat"))
    leaks = roles.target_leaks(df, "y", ["same", "scaled", "free", "flat"])
    assert leaks["same"] == "identical" and leaks["scaled"] == "correlated" and set(leaks) == {"same", "scaled"}


def test_frequency_of_months(spark):
    df = spark.createDataFrame([(dt.date(2020 + m // 12, m % 12 + 1, 1),) for m in range(24)], "d date")
    assert roles.infer_frequency(df, "d").first()["frequency"] == "M"
    assert roles.infer_frequency(df.limit(2), "d").first()["frequency"] is None


# ---------------------------------------------------------------- order statistics and matrices


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_by_narrowing(spark, keys):
    """A hot value, a hot group and a long tail; the narrowing path equals numpy."""
    rng = np.random.default_rng(7)
    values = np.concatenate([np.full(3000, 5.0), rng.lognormal(size=5000), -rng.random(1000)])
    groups = np.where(rng.random(len(values)) < 0.7, "hot", "cold")
    df = spark.createDataFrame(pd.DataFrame({"k": groups, "v": values})).repartition(6)
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.97, 1.0]
    got = order_stats.exact_quantiles(df, F.col("v"), probs, keys, direct_rows=50)
    for key, found in got.items():
        part = values if not keys else values[groups == key[0]]
        assert found == pytest.approx(np.percentile(part, [p * 100 for p in probs]).tolist(), abs=1e-12)
    assert len(got) == (2 if keys else 1)


def test_value_positions_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "_ROWS_PER_BUCKET", 100)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(0, 40, 600).astype(float), np.full(400, 7.0)])
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "v": values})).repartition(4)
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {r["v"]: (r["tied"], r["below"]) for r in order_stats.value_positions(counts, ["g"], "v", "n", 1000).collect()}
    assert got == {v: (int((values == v).sum()), int((values < v).sum())) for v in np.unique(values)}


def test_medians(spark):
    df = spark.createDataFrame([(1.0, None), (4.0, None), (None, None)], "a double, b double")
    assert order_stats.medians(df, {"a": F.col("a"), "b": F.col("b")}) == {"a": 2.5, "b": 0.0}


def test_skewness_forms_and_log(spark):
    rng = np.random.default_rng(2)
    x = rng.lognormal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "flat": 1.0, "neg": -x}))
    facts = matrix.column_facts(df, ["x", "flat", "neg"])
    assert facts["x"].skew == pytest.approx(pd.Series(x).skew()) and facts["flat"].skew is None
    assert matrix.skewed_columns(facts) == ["x"]
    assert [r["column_name"] for r in matrix.variance_table(df, ["x", "flat"]).collect()] == ["x"]


def test_correlation_of_constants_and_gaps(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, 5], "b": [2.0, 1, 4, 3, 5], "c": [1.0] * 5, "d": [1.0, None, 2.0, 5.0, 4.0]})
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf.columns])
    frame, truncated = matrix.correlation_frame(df, list(pdf.columns))
    got = {(r["x"], r["y"]): r["value"] for r in frame.collect()}
    want = pdf.corr().fillna(0.0)
    assert not truncated and all(got[(x, y)] == pytest.approx(round(want.loc[x, y], 4)) for x in pdf for y in pdf)
    frame, truncated = matrix.correlation_frame(df, list(pdf.columns), limit=2)
    assert truncated and frame.count() == 4


def test_pooled_ridge_equals_direct_solution(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(loc=[1e6, 3, 0], scale=[2, 5, 1], size=(300, 3))
    x[:, 2] = 4.0
    y = x[:, 0] * 3 - x[:, 1] + rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    models = matrix.pooled_ridge(df, ["a", "b", "c"], "y", [1.0, 10.0])
    sd = np.where(x.std(0) > 0, x.std(0), 1)
    z = (x - x.mean(0)) / sd
    for alpha, m in models.items():
        beta = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean())) / sd
        assert m.coefficients == pytest.approx(beta.tolist(), rel=1e-6, abs=1e-9)


def test_quantiles_of_counted_values(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(v), int(n)) for k in ("a", None) for v, n in zip(rng.permutation(900), rng.integers(1, 40, 900))]
    df = spark.createDataFrame(rows, "k string, v double, n bigint").repartition(4)
    probs = [0.0, 0.25, 0.333, 0.5, 1.0]
    got = order_stats.exact_quantiles(df, F.col("v"), probs, ["k"], direct_rows=100, copies="n")
    assert got == order_stats.exact_quantiles(df, F.col("v"), probs, ["k"], copies="n")
    for key in ("a", None):
        values = np.repeat([v for k, v, _ in rows if k == key], [n for k, _, n in rows if k == key])
        assert got[(key,)] == pytest.approx(np.quantile(values, probs))
    odd = spark.createDataFrame([(1.0,)] * 300 + [(float("nan"),)] * 5, "v double")
    assert order_stats.exact_quantiles(odd, F.col("v"), [0.5], direct_rows=10)[()] == [1.0]
