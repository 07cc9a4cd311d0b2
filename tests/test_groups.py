import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import frames, metrics
from millrace.operators import group_stats as gs
from millrace.plans.hypotheses import lift_parity, run_hypotheses


def promo(spark):
    rng = np.random.default_rng(8)
    flag = rng.integers(0, 2, 600)
    sales = rng.normal(1000, 80, 600) * np.where(flag == 1, 1.387, 1.0)
    pdf = pd.DataFrame({"Sales": sales, "Promo": flag})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_welch_lift(spark):
    pdf, df = promo(spark)
    report = run_hypotheses(df, "Sales", ["Promo"])
    t = report.tests.first()
    a, b = pdf.Sales[pdf.Promo == 0], pdf.Sales[pdf.Promo == 1]
    assert t["test"] == "welch_t" and (t["baseline_group"], t["comparison_group"]) == ("0", "1")
    assert t["statistic"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(a.var() / len(a) + b.var() / len(b)))
    assert t["lift_pct"] == pytest.approx((b.mean() / a.mean() - 1) * 100, abs=0.006)
    assert t["significant"] and t["robust"] and t["p_value"] < 1e-50
    assert lift_parity(report, 38.7, 2.0).first()["within_tolerance"]
    for r in report.group_stats.collect():
        want = np.percentile(a if r["level"] == "0" else b, [0, 25, 50, 75, 100])
        assert [r[c] for c in ("min", "q1", "median", "q3", "max")] == pytest.approx(np.round(want, 4).tolist(), abs=1e-4)


def test_twelve_largest_groups(spark):
    sizes = [10 + 10 * i for i in range(20)]
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"category": np.repeat([f"g{i:02d}" for i in range(20)], sizes)})
    pdf["value"] = rng.normal(size=len(pdf))
    report = run_hypotheses(spark.createDataFrame(pdf).repartition(5), "value", ["category"], most_groups=12)
    t = report.tests.first()
    assert t["test"] == "anova" and t["n_groups"] == 12 and t["df"] == 11
    assert {r["level"] for r in report.group_stats.collect()} == {f"g{i:02d}" for i in range(8, 20)}


def test_rank_checks_against_brute_force(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"two": rng.integers(0, 2, 200), "three": rng.choice(["x", "y", "z"], 200), "v": rng.integers(0, 15, 200).astype(float)})
    pdf["v"] += pdf["two"] * 1.5
    report = run_hypotheses(spark.createDataFrame(pdf).repartition(6), "v", ["two", "three"])
    got = {r["grouping_column"]: r for r in report.tests.collect()}
    ranks = pdf["v"].rank()
    n = len(pdf)
    ties = sum(c**3 - c for c in pdf["v"].value_counts())
    n1 = (pdf.two == 0).sum()
    n2 = n - n1
    u = ranks[pdf.two == 0].sum() - n1 * (n1 + 1) / 2
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    assert got["two"]["nonparametric_p"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    h = 12 / (n * (n + 1)) * sum(ranks[pdf.three == g].sum() ** 2 / (pdf.three == g).sum() for g in "xyz") - 3 * (n + 1)
    assert got["three"]["nonparametric_p"] == pytest.approx(math.exp(-h / (1 - ties / (n**3 - n)) / 2))
    assert got["two"]["p_value_adjusted"] == pytest.approx(min(1, 2 * got["two"]["p_value"]))


def test_skips_and_degenerate_groups(spark):
    rows = [(float(i % 3), i % 2, i, "only", float(i // 10)) for i in range(20)] + [(5.0, 1, 99, None, 9.0)]
    df = spark.createDataFrame(rows, "y double, g int, spread int, one string, z double")
    report = run_hypotheses(df, "y", ["g", "spread", "one", "nope"])
    reasons = {r["grouping_column"]: r["reason"] for r in report.skipped.collect()}
    assert reasons["nope"] == "not_a_column" and reasons["spread"] == "too_few_groups" and reasons["one"] == "too_few_groups"
    flat = run_hypotheses(spark.createDataFrame([(1.0, "a")] * 6 + [(2.0, "b")] * 6, "y double, g string"), "y", ["g"])
    assert flat.status == "insufficient_data" and flat.skipped.first()["reason"] == "no_variance"


def test_roles_of_wholesale(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"Channel": rng.integers(1, 3, 440), "Region": rng.integers(1, 4, 440), "Fresh": rng.lognormal(9, 1.5, 440), "Milk": rng.lognormal(8, 1, 440)})
    report = run_hypotheses(spark.createDataFrame(pdf))
    got = {r["grouping_column"]: r["test"] for r in report.tests.collect()}
    assert report.target == "Fresh" and got == {"Channel": "welch_t", "Region": "anova"}
    assert all(r["skew_warning"] for r in report.tests.collect()) and any("skewed" in n for n in report.notes)


def test_holm(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p_value double")
    got = [r["p_value_adjusted"] for r in gs.holm(df).orderBy("p_value").collect()]
    assert got == pytest.approx([0.04, 0.09, 0.09, 0.5])


def test_pooled_skewness(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b", "c"], [50, 80, 5]), "y": np.concatenate([rng.lognormal(size=50), rng.normal(size=80), np.full(5, 2.0)])})
    pooled = gs.pooled_by("grouping_column", gs.level_moments(gs.long_groups(spark.createDataFrame(pdf), "y", ["g"]))).first()
    d = pdf.y - pdf.y.mean()
    assert pooled["skew"] == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5)


def test_rmspe_literals(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 190.0), (50.0, 55.0)], "y double, p double")
    assert metrics.demand_metrics(df, "y", "p").first()["rmspe"] == pytest.approx(8.66025, abs=1e-5)
    zeros = df.select((F.col("y") * 0).alias("y"), "p")
    assert metrics.demand_metrics(zeros, "y", "p").first()["rmspe"] == 0.0
    r = metrics.regression_metrics(zeros, "y", "p").first()
    assert r["rmspe"] is None and r["r2"] is None and r["n_zero_actuals"] == 3


def test_confusion_and_gate(spark):
    df = spark.createDataFrame([(True, True)] * 9 + [(True, False)] + [(False, True)] * 2 + [(False, False)] * 20, "t boolean, f boolean")
    r = metrics.detector_gate(metrics.confusion(df, "t", "f")).first()
    assert (r["true_positives"], r["false_positives"], r["false_negatives"], r["true_negatives"]) == (9, 2, 1, 20)
    assert r["recall"] == 0.9 and r["passes"]
    empty = metrics.confusion(df.where("false"), "t", "f").first()
    assert empty["precision"] == 0.0


def test_scatter_keeps_every_outlier(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).alias("is_outlier")).repartition(5)
    got = frames.scatter_points(df, cap=150, id_col="id")
    assert got.count() == 150 and got.where("is_outlier").count() == 100
    assert frames.scatter_points(df, cap=50, id_col="id").count() == 100
    assert sorted(got.collect()) == sorted(frames.scatter_points(df.repartition(3), cap=150, id_col="id").collect())


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.99,), (10.0,), (None,)], "v double")
    got = {r["bin"]: r["count"] for r in frames.histogram(df, "v", 10).collect()}
    assert got == {0: 1, 1: 1, 9: 2}
