import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.cadence import CADENCES
from millrace.operators import encoding, grid, lagging, retail
from millrace.plans import forecast as fc
from millrace.plans import panel_training as pt


def daily(spark, values, start="2022-01-01", key=None):
    days = pd.date_range(start, periods=len(values))
    rows = [(key or "s", d.date(), float(v)) for d, v in zip(days, values)]
    return spark.createDataFrame(rows, "series string, period date, y double")


def retail_log(spark):
    rows = [
        ("1", 2, 3.0, "12/1/2010 8:26", 17850.0), ("1", 1, 4.0, "12/1/2010 8:26", 17850.0), ("C2", -1, 3.0, "12/3/2010 9:00", 17850.0),
        ("3", 5, 0.0, "12/3/2010 10:00", 12583.0), ("4", -2, 1.0, "12/3/2010 11:00", 12583.0), ("5", 10, 1.5, "12/13/2010 12:00", None),
        ("6", 1, None, "12/4/2010 12:00", 0.0),
    ]
    return spark.createDataFrame(rows, "InvoiceNo string, Quantity int, UnitPrice double, InvoiceDate string, CustomerID double")


def test_retail_revenue_and_counters(spark):
    log = retail_log(spark)
    got = {r["date"].isoformat(): r["net_revenue"] for r in retail.daily_net_revenue(log).collect()}
    assert got == {"2010-12-01": 10.0, "2010-12-03": -2.0, "2010-12-13": 15.0}
    q = retail.quality_counters(log).first()
    assert tuple(q) == (7, 1, 1, 2, 1, 4)


def test_rfm_literals(spark):
    got = {r["CustomerID"]: r for r in retail.customer_rfm(retail_log(spark)).collect()}
    assert set(got) == {"17850", "12583"}
    a, b = got["17850"], got["12583"]
    # Latest date among valid customers is 2010-12-03; date strings carry no time of day here.
    assert a["Recency"] == 1.0 and a["Frequency"] == 2.0 and a["Monetary"] == 10.0 and a["Return Ratio"] == pytest.approx(1 / 3)
    assert b["Monetary"] == 0.0 and b["Return Ratio"] == 0.5


def test_rfm_of_one_hot_customer(spark):
    """A customer with most lines gives the same figures as a plain aggregation."""
    df = spark.range(20_000).select(
        F.concat(F.lit("i"), F.col("id") % 997).alias("InvoiceNo"), (F.col("id") % 7 - 1).cast("int").alias("Quantity"),
        F.lit(2.0).alias("UnitPrice"), F.timestamp_seconds(F.col("id") * 1000).cast("timestamp_ntz").alias("InvoiceDate"),
        F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 50 + 2).alias("CustomerID"),
    )
    got = retail.customer_rfm(df).where("CustomerID = '1'").first()
    p = df.toPandas()
    p = p[p.CustomerID == 1]
    amount = p.Quantity * p.UnitPrice
    assert got["Frequency"] == p.InvoiceNo.nunique() and got["Monetary"] == amount[amount > 0].sum()


def test_grid_and_interpolation_match_pandas(spark):
    rng = np.random.default_rng(3)
    days = pd.date_range("2023-12-20", periods=80)[rng.random(80) < 0.5]
    values = rng.normal(size=len(days))
    s = pd.Series(values, index=days)
    df = spark.createDataFrame([("a", d.date(), float(v)) for d, v in s.items()], "k string, period date, y double").repartition(6)
    dense = grid.dense_grid(df, "D", ["k"])
    got = grid.interpolate_linear(dense, ["y"], ["k"]).orderBy("period").collect()
    want = s.reindex(pd.date_range(s.index.min(), s.index.max())).interpolate(limit_direction="both")
    assert [r["period"] for r in got] == [d.date() for d in want.index]
    assert [r["y"] for r in got] == pytest.approx(want.tolist())
    assert sum(r["is_gap"] for r in got) == len(want) - len(s)


@pytest.mark.parametrize("code, starts", [("W", ["2024-01-01", "2024-01-22"]), ("M", ["2023-11-01", "2024-02-01"]), ("Q", ["2023-10-01", "2024-07-01"])])
def test_grid_of_longer_periods(spark, code, starts):
    df = spark.createDataFrame([("a", dt.date.fromisoformat(d), 1.0) for d in starts], "k string, period date, y double")
    got = [r["period"] for r in grid.dense_grid(df, code, ["k"]).orderBy("period").collect()]
    assert len(got) == 4 and got[0].isoformat() == starts[0] and got[-1].isoformat() == starts[1]


def test_edges_are_held(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, d), v) for d, v in [(1, None), (2, 4.0), (3, None), (4, 8.0), (5, None)]], "k string, period date, y double")
    assert [r["y"] for r in grid.interpolate_linear(df, ["y"], ["k"]).orderBy("period").collect()] == [4, 4, 6, 8, 8]
    carried = grid.carry_last(df, ["y"], ["k"]).orderBy("period").collect()
    assert [r["y"] for r in carried] == [4, 4, 4, 8, 8]


def test_features_match_pandas(spark):
    y = pd.Series(np.random.default_rng(0).normal(size=70), index=pd.date_range("2024-01-01", periods=70))
    df = daily(spark, y.tolist(), "2024-01-01").repartition(5)
    got = lagging.series_features(df, "y", "D", (1, 7), (7,), (), ["series"]).orderBy("period").toPandas()
    base = y.shift(1).rolling(7, min_periods=7)
    for column, want in {"lag_7": y.shift(7), "roll7_mean": base.mean(), "roll7_std": base.std(), "roll7_max": base.max()}.items():
        np.testing.assert_allclose(got[column].astype(float), want.to_numpy())
    assert got["dow"].tolist() == y.index.dayofweek.tolist() and got["weekofyear"].tolist() == y.index.isocalendar().week.tolist()


def test_last_target_touches_nothing_earlier(spark):
    """Leakage invariant: a changed last target leaves every feature and encoding as it was."""
    values = list(np.random.default_rng(1).normal(100, 10, 90))

    def features(v):
        wide = lagging.series_features(daily(spark, v), "y", "D", (1, 7, 14), (7, 30), (), ["series"])
        code = encoding.expanding_encoding(F.col("y"), F.col("dow"), ["series"], "period")
        return wide.withColumn("enc", code).drop("y").orderBy("period").collect()

    assert features(values) == features(values[:-1] + [1e6])


def test_expanding_encoding_literals(spark):
    y, cats = [10.0, 20.0, 30.0, 40.0, 50.0, 60.0], [0, 0, 0, 1, 1, 1]
    df = spark.createDataFrame([("s", i, v, c) for i, (v, c) in enumerate(zip(y, cats))], "series string, period int, y double, c int")
    got = [r[0] for r in df.select("period", encoding.expanding_encoding(F.col("y"), F.col("c"), ["series"], "period").alias("e")).orderBy("period").select("e").collect()]
    want = []
    for i in range(6):
        own = [v for v, c in zip(y[:i], cats[:i]) if c == cats[i]]
        want.append((sum(own) + 10 * (sum(y[:i]) / i if i else 0)) / (len(own) + 10))
    assert got == pytest.approx(want)


def test_encoding_lookup_default(spark):
    train = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("b", 60.0)], "c string, y double")
    table = encoding.encoding_table(train, "y", "c")
    got = {r["c"]: r["e"] for r in encoding.apply_encoding(spark.createDataFrame([("a",), ("zz",)], "c string"), table, "c", "e").collect()}
    assert got == pytest.approx({"a": (30 + 10 * 30) / 12, "zz": 30.0})


def test_panel_features_brute_force(spark):
    rows = [(s, (pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)).date(), (i + 1) * 10) for s in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "store_id int, date date, units_sold int").repartition(7)
    got = lagging.panel_features(df).where("store_id = 2").orderBy("date").collect()
    assert len(got) == 10
    first = got[0]
    assert first["lag_7"] == 240 and first["lag_30"] == 10 and first["rolling_mean_7"] == pytest.approx(np.mean([240 + 10 * k for k in range(7)]))
    head = lagging.panel_features(df, drop_incomplete=False).where("store_id = 1").orderBy("date").limit(2).collect()
    assert head[1]["rolling_mean_7"] == 10 and head[1]["rolling_std_7"] == 0.0 and head[0]["rolling_mean_7"] is None


# ---------------------------------------------------------------- forecasts


def seasonal(spark, n=400, keys=("a", "b")):
    rng = np.random.default_rng(2)
    rows = []
    for j, k in enumerate(keys):
        for i in range(n):
            day = pd.Timestamp("2022-01-03") + pd.Timedelta(days=i)
            rows.append((k, day.date(), float(100 * (j + 1) + 30 * np.sin(2 * np.pi * i / 7) + rng.normal(0, 2)), float(i % 7)))
    # The input is named like a calendar feature on purpose.
    return spark.createDataFrame(rows, "shop string, day date, sales double, month double").repartition(6)


def test_ridge_forecast_of_a_panel(spark):
    prep = fc.prepare_series(seasonal(spark), "sales", "day", ["shop"])
    report = fc.run_forecast(prep, 14, boosted=False)
    rows = report.forecast.collect()
    assert len(rows) == 28 and {r["model"] for r in rows} == {"ridge"}
    assert all(r["lower"] <= r["forecast"] <= r["upper"] and r["lower"] >= 0 for r in rows)
    truth = {(k, s): 100 * (j + 1) + 30 * np.sin(2 * np.pi * (399 + s) / 7) for j, k in enumerate("ab") for s in range(1, 15)}
    assert all(abs(r["forecast"] - truth[(r["shop"], r["step"])]) < 12 for r in rows)
    assert report.selection.first()["skill"] > 0
    assert report.metrics.where("model = 'ridge'").first()["n"] == 42


def test_recursion_matches_step_by_step_numpy(spark):
    """The array fold of the linear model equals a plain loop over the same features."""
    prep = fc.prepare_series(seasonal(spark, 200, ("a",)).drop("month"), "sales", "day", ["shop"])
    report = fc.run_forecast(prep, 5, boosted=False)
    got = [r["forecast"] for r in report.forecast.orderBy("step").collect()]
    frame, names, _ = fc.model_frame(prep)
    weights = fc.ridge_per_series(frame, ["shop"]).first()
    last = frame.orderBy(F.desc("period")).first()
    y = [r["y"] for r in frame.orderBy("period").select("y").collect()]
    dows = {r["dow"]: r["fold_enc_dow"] for r in frame.select("dow", "fold_enc_dow").distinct().collect()}
    months = {r["month"]: r["fold_enc_month"] for r in frame.where("train").select("month", "fold_enc_month").distinct().collect()}
    for step in range(1, 6):
        day = pd.Timestamp(last["period"]) + pd.Timedelta(days=step)
        f = {
            "month": day.month, "quarter": day.quarter, "month_sin": np.sin(2 * np.pi * (day.month - 1) / 12), "month_cos": np.cos(2 * np.pi * (day.month - 1) / 12),
            "dow": day.dayofweek, "dom": day.day, "weekofyear": day.isocalendar().week, "is_weekend": int(day.dayofweek >= 5),
            "dow_sin": np.sin(2 * np.pi * day.dayofweek / 7), "dow_cos": np.cos(2 * np.pi * day.dayofweek / 7),
            "enc_dow": dows[day.dayofweek], "enc_month": months.get(day.month, last["fold_default"]),
        }
        f |= {f"lag_{n}": y[-n] for n in CADENCES["D"].lags}
        for w in CADENCES["D"].windows:
            tail = np.array(y[-w:])
            f |= {f"roll{w}_mean": tail.mean(), f"roll{w}_std": tail.std(ddof=1), f"roll{w}_min": tail.min(), f"roll{w}_max": tail.max()}
        x = np.array([f[n] for n in names])
        value = max(0.0, float(x @ np.array(weights["refit"]) + weights["refit_base"]))
        assert got[step - 1] == pytest.approx(value, rel=1e-9)
        y.append(value)


def test_boosted_contest_and_recursion(spark):
    prep = fc.prepare_series(seasonal(spark, 150), "sales", "day", ["shop"])
    report = fc.run_forecast(prep, 10, maxIter=3)
    assert fc.gate_summary(fc.store_gate(report)).where("model = 'ridge'").first()["series"] == 2
    assert {r["model"] for r in report.metrics.select("model").distinct().collect()} == {"ridge", "boosted", "seasonal_naive"}
    assert report.forecast.count() == 20
    # The stepwise form must agree with the array fold when the model is the same linear one.
    frame, _, _ = fc.model_frame(prep)
    ridge = fc.ridge_per_series(frame, ["shop"])
    states = fc.durable(fc._states(prep, frame).join(ridge.select("shop", "refit", "refit_base"), "shop"))
    slow = fc.advance_stepwise(prep, states, 10, lambda s: s.withColumn("value", fc._dot(F.col("x"), F.col("refit")) + F.col("refit_base")))
    quick = {r["shop"]: r["path"] for r in fc.advance_ridge(prep, states, 10).collect()}
    for r in slow.collect():
        assert r["path"] == pytest.approx(quick[r["shop"]])


def test_short_and_irregular_series_are_rejected(spark):
    df = seasonal(spark, 120, ("long",)).unionByName(seasonal(spark, 30, ("short",)))
    odd = spark.createDataFrame([("odd", dt.date(2020 + i, 1 + i, 3), 1.0, 0.0) for i in range(5)], df.schema)
    prep = fc.prepare_series(df.unionByName(odd), "sales", "day", ["shop"])
    report = fc.run_forecast(prep, 3, boosted=False)
    reasons = {r["shop"]: r["reason"] for r in report.rejects.collect()}
    assert set(reasons) == {"short", "odd"} and "at least" in reasons["short"]
    assert {r["shop"] for r in report.forecast.collect()} == {"long"}


def test_degraded_results(spark):
    assert fc.forecast_table(spark.createDataFrame([(1.0, "x")], "v double, s string"))[0] == "no_date_column"
    assert fc.forecast_table(daily(spark, [1.0, 2.0]).select("period", "y"))[0] == "insufficient_data"


def test_monthly_series_of_strings(spark):
    rows = [(f"{1949 + m // 12}-{m % 12 + 1:02d}", 100 + m + 20 * np.sin(2 * np.pi * m / 12)) for m in range(144)]
    df = spark.createDataFrame([(a, float(b)) for a, b in rows], "Month string, `#Passengers` double")
    prep = fc.prepare_series(df)
    report = fc.run_forecast(prep, 12, boosted=False)
    assert prep.code == "M" and prep.date_format == "iso" and report.selection.first()["skill"] > 0.5
    assert [r["period"].isoformat() for r in report.forecast.orderBy("step").limit(2).collect()] == ["1961-01-01", "1961-02-01"]


def test_time_split_and_pooled_training(spark):
    df = seasonal(spark, 120, ("a", "b", "c")).select(F.ascii("shop").alias("store_id"), F.col("day").alias("date"), F.col("sales").alias("units_sold"))
    df = df.withColumn("row_index", F.col("store_id") * 1000 + F.datediff("date", F.lit("2022-01-01")))
    rows = lagging.panel_features(df)
    train, valid = pt.time_split(rows)
    assert (train.count(), valid.count()) == (216, 54)
    labels = valid.select("row_index", (F.col("store_id") == 97).alias("is_anomaly"))
    trained = pt.train_panel(df, labels, boosted={"maxIter": 3})
    got = {r["model"]: r for r in trained.metrics.collect()}
    assert got["ridge"]["n"] == 36 and got["ridge"]["r2"] > 0.9
    assert pt.gates(trained.metrics).count() == 1
