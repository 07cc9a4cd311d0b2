"""Inputs that used to give wrong answers: NaN, short and mixed series, line breaks in cells, date spellings, records without an id."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import clusters, frames, profile, roles
from millrace.plans import forecast as fc, segmentation as sg
from millrace.plans.hypotheses import run_hypotheses
from millrace.sources import tables


def series(spark, days=200, key=1, low=10.0, start="2024-01-01", step="D"):
    dates = pd.date_range(start, periods=days, freq=step)
    y = [low + 5 * (i % 7) + 0.01 * i for i in range(days)]
    return spark.createDataFrame(pd.DataFrame({"store": key, "day": dates.date, "units": y, "temp_input": [float(i % 11) for i in range(days)]}))


def steps(report):
    return [r["forecast"] for r in report.forecast.orderBy("period").collect()]


@pytest.mark.parametrize("column", ["temp_input", "units"])
def test_nan_reads_as_missing(spark, column):
    clean = series(spark)
    hole = F.col("temp_input") == 3
    outcomes = []
    for gap in (F.lit(float("nan")), F.lit(None).cast("double")):
        df = clean.withColumn(column, F.when(hole & (F.dayofyear("day") == 58), gap).otherwise(F.col(column)))
        outcomes.append(steps(fc.run_forecast(fc.prepare_series(df, "units", "day", ["store"]), 7, boosted=False)))
    assert outcomes[0] == outcomes[1] and all(math.isfinite(v) and v > 5 for v in outcomes[0])


def test_short_series_get_a_message(spark):
    status, _, _ = fc.forecast_table(series(spark, 30), 7, target="units", date_col="day", keys=["store"])
    assert status == "insufficient_data"


def test_one_negative_series_leaves_the_others_alone(spark):
    good = series(spark, key=1)
    bad = series(spark, key=2, low=-30.0)
    alone = fc.run_forecast(fc.prepare_series(good, "units", "day", ["store"]), 7, maxIter=5)
    both = fc.run_forecast(fc.prepare_series(good.unionByName(bad), "units", "day", ["store"]), 7, maxIter=5)
    wanted = {(r["model"], round(r["rmse"], 6)) for r in alone.metrics.collect()}
    assert {(r["model"], round(r["rmse"], 6)) for r in both.metrics.where("store = 1").collect()} == wanted
    assert {r["model"] for r in both.metrics.where("store = 2").collect()} == {"ridge", "boosted", "seasonal_naive"}


def test_every_cadence_is_forecast(spark):
    df = series(spark, 200, 1).unionByName(series(spark, 72, 2, start="2018-01-01", step="MS")).unionByName(series(spark, 200, 3))
    reports = fc.forecast_all_cadences(df, "day", ["store"], "units", {"D": 7, "M": 3}, boosted=False)
    assert {c: sorted({r["store"] for r in rep.forecast.collect()}) for c, rep in reports.items()} == {"D": [1, 3], "M": [2]}


def test_cells_with_line_breaks(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    pd.DataFrame({"a": [1, 2], "b": ["one\ntwo, three", 'say ""x""'], "c": [3, 4]}).to_csv(path, index=False)
    assert tables.has_line_breaks(spark, path)
    rows = tables.read_table(spark, path).orderBy("a").collect()
    assert [(r["a"], r["c"]) for r in rows] == [(1, 3), (2, 4)] and rows[0]["b"] == "one\ntwo, three"
    plain = str(tmp_path / "p.csv")
    pd.DataFrame({"a": range(3000), "b": ["x;y"] * 3000}).to_csv(plain, index=False)
    assert not tables.has_line_breaks(spark, plain) and tables.sniff_delimiter(spark, plain) == ","


@pytest.mark.parametrize("pattern", ["%d/%m/%Y", "%d/%m/%Y %H:%M", "%Y/%m/%d", "%d %b %Y", "%d %B %Y", "%Y%m%d", "%b %d, %Y", "%d.%m.%Y", "%Y-%m-%d"])
def test_date_spellings(spark, pattern):
    days = [d.strftime(pattern) for d in pd.date_range("2024-01-01", periods=60)]
    types = profile.semantic_types(spark.createDataFrame([(d,) for d in days], "at string")).collect()
    assert types[0]["inferred_type"] == "datetime"


def test_words_and_numbers_are_no_dates(spark):
    rows = [("AB 12 2024", "99999999", "12 apples")] * 30
    types = {r["column_name"]: r["inferred_type"] for r in profile.semantic_types(spark.createDataFrame(rows, "a string, b string, c string")).collect()}
    assert "datetime" not in types.values()


def test_records_without_an_id(spark):
    rows = [(float(i % 10), float(i // 10), i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, g int").withColumn("anomaly_score", F.col("a") * 0.1)
    plain = frames.top_outliers(df, n=20)
    assert plain.where("record_id IS NULL").count() == 0
    spread = frames.top_outliers(df.repartition(9), n=20)
    assert sorted(map(str, plain.collect())) == sorted(map(str, spread.collect()))
    keyed = frames.top_outliers(df, n=1, keys=("a", "b")).first()
    assert keyed["record_id"] == "9.0-0.0"
    one = clusters.hash_sample(df, 30).collect()
    assert sorted(map(str, one)) == sorted(map(str, clusters.hash_sample(df.repartition(7), 30).collect()))


def test_all_columns_can_leak_and_correlate(spark):
    rng = random.Random(1)
    rows = [tuple(float(rng.randrange(100)) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame([(*r, r[-1], r[-2] + r[-3]) for r in rows], [f"c{i}" for i in range(30)] + ["y", "z"])
    assert roles.target_leaks(df, "y", [f"c{i}" for i in range(30)]) == {"c29": "identical"}
    assert roles.target_leaks(df, "z", [f"c{i}" for i in range(30)]) == {"c28": "pair_sum:c27", "c27": "pair_sum:c28"}


def test_all_tests_are_corrected_for(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(0, 1), *[rng.randrange(2) for _ in range(11)]) for _ in range(300)]
    df = spark.createDataFrame(rows, ["y", *[f"g{i}" for i in range(11)]])
    every = run_hypotheses(df, "y").tests.orderBy("p_value").collect()
    assert len(every) == 11 and every[0]["p_value_adjusted"] == pytest.approx(min(1.0, 11 * every[0]["p_value"]))
    some = run_hypotheses(df, "y", max_tests=3)
    assert [r["p_value_adjusted"] for r in some.tests.orderBy("p_value").collect()] == [r["p_value_adjusted"] for r in every[:3]]
    assert some.skipped.where("reason = 'not_shown_of:11'").count() == 8
    assert {r["nonparametric_method"] for r in every} == {"normal"}


def test_segments_do_not_depend_on_the_partitioning(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(i % 3 * 8, 1), rng.gauss(i % 3 * -5, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, a double, b double")
    found = [sg.run_segmentation(d, trees=5) for d in (df, df.repartition(5))]
    assert found[0].k == found[1].k == 3
    assert {r["record_id"] for r in found[0].outlier_records(10).collect()} == {r["record_id"] for r in found[1].outlier_records(10).collect()}
