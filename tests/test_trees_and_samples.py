"""Node arrays of ensembles, staged grids, the boosted recursion and the samples of the forest."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from millrace.operators import clusters, forest, matrix, roles, trees
from millrace.operators.clusters import assemble
from millrace.plans import forecast as fc
from millrace.plans import panel_training as pt


@pytest.fixture(scope="module")
def folds(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 3))
    y = 60 + 8 * x[:, 0] + 5 * np.abs(x[:, 1]) + rng.normal(size=1200)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "units": y})).repartition(3).persist()
    return df.limit(900).persist(), df.where("a > 0.2").persist()


def test_node_arrays_predict_what_the_model_predicts(spark, folds):
    train, valid = folds
    data = assemble(train.select("a", "b", "c", F.col("units").alias("label")), ["a", "b", "c"])
    model = trees.fit_trees(data.select("features", "label"), maxIter=12, maxDepth=4, stepSize=0.2, seed=1)
    ensemble = trees.from_boosted(model, spark)
    rows = model.transform(assemble(valid, ["a", "b", "c"])).select("a", "b", "c", "prediction").toPandas()
    assert ensemble.predict(rows[["a", "b", "c"]].to_numpy()) == pytest.approx(rows["prediction"].to_numpy(), rel=1e-12)
    assert len(ensemble.roots) == 12 and ensemble.predict(np.zeros((0, 3))).shape == (0,)


def test_a_staged_point_equals_a_fit_of_that_length(folds):
    train, valid = folds
    grid = {"maxDepth": (2, 3), "maxIter": (4, 9, 6), "stepSize": (0.1, 0.3)}
    found = {(r["maxDepth"], r["maxIter"], r["stepSize"]): r for r in pt.tree_grid(train, valid, ["a", "b", "c"], "units", grid).collect()}
    assert len(found) == 12
    alone = pt.tree_grid(train, valid, ["a", "b", "c"], "units", {"maxDepth": (3,), "maxIter": (6,), "stepSize": (0.3,)}).first()
    for name in ("rmspe", "mae", "rmse", "r2"):
        assert found[3.0, 6.0, 0.3][name] == pytest.approx(alone[name], rel=1e-9)


def panel(spark, signs):
    start, rows = dt.date(2021, 1, 1), []
    rng = np.random.default_rng(2)
    for shop, sign in signs.items():
        for i in range(140):
            level = 50 + 10 * np.sin(i * 2 * np.pi / 7) + rng.normal()
            rows.append((shop, start + dt.timedelta(days=i), float(level if sign else level - 55), float(i % 5) if i % 11 else None))
    return spark.createDataFrame(rows, "shop string, day date, sales double, price double")


def test_boosted_recursion_in_one_pass_equals_single_steps(spark):
    prep = fc.prepare_series(panel(spark, {"p": True, "q": True, "n": False}), "sales", "day", ["shop"])
    frame, _, _ = fc.model_frame(prep)
    frame = frame.persist()
    models = {sign: fc.fit_boosted(frame.where(F.col("nonneg") == sign), sign, maxIter=4) for sign in (True, False)}
    boosted = fc.Boosted(models)
    states = fc.durable(fc._states(prep, frame).withColumns({"selected": F.lit("boosted"), "rmse": F.lit(1.0)}))
    got = {r["shop"]: r["path"] for r in fc.advance_boosted(prep, states, 9, {s: trees.from_boosted(m, spark) for s, m in models.items()}).collect()}
    assert got.keys() == {"p", "q", "n"}
    for sign in (True, False):
        slow = fc.advance_stepwise(prep, states.where(F.col("nonneg") == sign), 9, lambda s, sign=sign: boosted.predict_sign(s, sign))
        for r in slow.collect():
            assert got[r["shop"]] == pytest.approx(r["path"], rel=1e-9)


def test_equal_rows_are_drawn_as_rows(spark):
    """A vector with a third of all rows has about a third of each sample, under any partitioning, with and without an id."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"), F.lit(1.0).alias("w"), "id")
    for id_col in (None, "id"):
        got = forest.draw_samples(df.repartition(5), ["v", "w"], 40, 256, 60_000, id_col=id_col).toPandas()
        assert (got.groupby("tree").size() == 256).all() and got["tree"].nunique() == 40
        share = (got["f0"] == 7.0).groupby(got["tree"]).mean()
        assert abs(share.mean() - 1 / 3) < 0.02 and share.between(0.18, 0.5).all()
        # Different rows are drawn evenly: the others' mean value is that of the table.
        assert abs(got.loc[got["f0"] != 7.0, "f0"].mean() / 30_000 - 1) < 0.05
        again = forest.draw_samples(df.repartition(2), ["v", "w"], 40, 256, 60_000, id_col=id_col).toPandas()
        order = ["tree", "draw", "f0"]
        assert got.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))


def test_samples_of_small_and_of_constant_tables(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,)], "v double")
    got = forest.draw_samples(df, ["v"], 3, 4, 4).toPandas()
    assert (got.groupby("tree").size() == 4).all() and (got["f0"] == 1.0).groupby(got["tree"]).sum().tolist() == [2, 2, 2]
    same = spark.range(5000).select(F.lit(3.0).alias("v"))
    assert (forest.draw_samples(same, ["v"], 5, 256, 5000).toPandas().groupby("tree").size() == 256).all()
    grown = forest.fit_forest(same, ["v"], 5)
    assert grown.score(same).agg(F.countDistinct("anomaly_score")).first()[0] == 1


def test_sample_sizes_are_binomial():
    """The number of a vector's copies in a tree has the mean and variance of draws without replacement from the candidates."""
    rng = np.random.default_rng(0)
    u = rng.random(20_000)
    some = -np.expm1(6 * 10 * np.log1p(-0.02))
    kept = u < some
    batch = pd.DataFrame({"f0": np.arange(20_000.0), "copies": 6, "u": u, "luck": rng.integers(-(1 << 62), 1 << 62, 20_000)})[kept]
    found = forest._dealt(batch, ["f0"], 10, 0.02, 1)
    assert abs(len(found) / (20_000 * 60 * 0.02) - 1) < 0.02
    sizes = found.groupby("f0").size().reindex(np.arange(20_000.0), fill_value=0)
    assert abs(sizes.var() / (60 * 0.02 * 0.98) - 1) < 0.05 and found["draw"].between(0, 0.02).all()
    assert found["tree"].value_counts().between(2150, 2650).all()


def brute_silhouette(x, labels):
    gap, widths = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), []
    for i in range(len(x)):
        means = {c: gap[i, (labels == c) & (np.arange(len(x)) != i)] for c in set(labels)}
        if not len(means[labels[i]]):
            widths.append(0.0)
            continue
        a, b = means[labels[i]].mean(), min(m.mean() for c, m in means.items() if c != labels[i])
        widths.append((b - a) / max(a, b))
    return float(np.mean(widths))


def test_silhouette_is_exact_on_small_and_near_on_large_tables(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 1.0, size=(n, 3)) for c, n in ((0, 500), (2.2, 300), (6, 1))])
    x[:120] = x[0]  # equal rows count as rows
    labels = np.repeat([0, 3, 7], [500, 300, 1])
    frame = assemble(spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(cluster=labels)), list("abc")).select("features", "cluster").persist()
    truth = brute_silhouette(x, labels)
    exact = clusters.silhouette(frame, rows=512)
    assert exact.value == pytest.approx(truth, abs=1e-6) and exact.low == exact.high == exact.value
    rough = clusters.silhouette(frame)
    assert abs(rough.value - truth) < 0.03 and rough.low < rough.value < rough.high and rough.high - rough.low < 0.12
    # A limit at the very value forces doubling until the samples hold every row.
    assert clusters.silhouette(frame, limit=truth + 1e-4).value == pytest.approx(truth, abs=1e-2)
    assert clusters.silhouette(frame.where("cluster = 0")) is None


def test_pair_sums_with_missing_values_equal_a_test_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 40)) * 100, 2)
    y = x[:, 4] + x[:, 31]
    x[:, 12] = np.where(rng.random(400) < 0.5, np.nan, y - x[:, 20])
    x[:, 33] = y - x[:, 20] + (np.arange(400) == 399)  # one row breaks it
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(40)]).assign(y=y)
    pdf["c39"] = [1.0] * 3 + [None] * 397  # never more than three common rows
    df = spark.createDataFrame(pdf).repartition(4)
    assert roles.pair_sum_hits(df, "y", [f"c{i}" for i in range(40)]) == [("c4", "c31"), ("c12", "c20")]
    assert roles.pair_sum_hits(df.limit(0), "y", ["c1", "c2"]) == [] and roles.pair_sum_hits(df, "y", ["c1"]) == []


def test_pairwise_moments_of_many_columns_with_gaps(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 60)) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7], x[:, 8] = 5.0, np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(60)])
    got, _ = matrix.correlation_frame(spark.createDataFrame(pdf).repartition(3), list(pdf.columns))
    want = pdf.corr().fillna(0.0)
    for r in got.collect():
        assert r["value"] == pytest.approx(want.loc[r["x"], r["y"]], abs=1e-4)
