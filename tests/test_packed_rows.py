"""Packed scans, thinned draws, weighed rows and what is read from them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import functions as F

from millrace.operators import clusters, forest
from millrace.plans import segmentation as sg


def points(n=6000, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.normal(0, 1, n).round(2), rng.random(n)]).astype(float)
    x[: n // 3] = x[0]
    return x


def sums(rows, sets):
    return {(r["at"], r["cluster"]): (r["n"], r["cost"], *r["total"]) for r in clusters.centre_sums(rows, sets).collect()}


def test_packed_rows_give_the_sums_of_single_rows(spark):
    df = spark.createDataFrame(pd.DataFrame(points(), columns=list("abc"))).repartition(3)
    plain = df.select(F.array(*"abc").alias("x"))
    counted = plain.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    x = points()
    # Two equal centres, and two at the same distance of all rows of one value.
    sets = [x[[0, 2500, 4000, 5000]], np.array([[3.0, 0, 0.5], [5.0, 0, 0.5], [4.0, 9, 0.5]]), np.vstack([x[5000], x[5000], x[4000]])]
    wanted = sums(plain, sets)
    for rows in (plain, counted):
        blocks = clusters.packed_vectors(rows)
        got = sums(blocks, sets)
        assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k], rel=1e-9, abs=1e-6) for k in wanted)


def test_most_leaves_are_taken_as_a_whole():
    rng = np.random.default_rng(1)
    low = rng.random((5000, 3))
    centres = rng.random((4, 3))
    own, whole = clusters._whole(low, low + 0.03, centres)
    assert whole.mean() > 0.7
    for _ in range(20):
        inside = low + 0.03 * rng.random(low.shape)
        nearest = ((inside[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        assert (nearest[whole] == own[whole]).all()


def test_many_iterations_equal_plain_scans(spark, monkeypatch):
    df = clusters.assemble(spark.createDataFrame(pd.DataFrame(points(2000), columns=list("abc"))), list("abc")).persist()
    packed = clusters.kmeans_of_starts(df, [4], 3, max_iter=60, tol=1e-8)[4]
    monkeypatch.setattr(clusters, "_PACKED_FROM", 1000)
    plain = clusters.kmeans_of_starts(df, [4], 3, max_iter=60, tol=1e-8)[4]
    assert np.allclose(packed.points, plain.points) and packed.cost == pytest.approx(plain.cost)


def test_rows_are_counted_only_where_they_repeat(spark, monkeypatch):
    monkeypatch.setattr(clusters, "COUNTED_ROWS", 100)
    base = spark.range(20_000)
    few = clusters.weighed_vectors(base.select((F.col("id") % 700).alias("p"), F.lit(1).alias("q")), ["p", "q"], 20_000)
    assert few.columns == ["x", "copies"] and few.count() == 700 and few.agg(F.sum("copies")).first()[0] == 20_000
    many = clusters.weighed_vectors(base.select("id", F.lit(1).alias("q")), ["id", "q"], 20_000)
    assert many.columns == ["x"] and many.count() == 20_000 and "Exchange" not in many._jdf.queryExecution().toString()


@pytest.mark.parametrize("id_col", [None, "id"])
def test_thinning_before_the_count_changes_no_draw(spark, monkeypatch, id_col):
    pdf = pd.DataFrame({"v": np.r_[np.zeros(9000), np.arange(9000.0)], "w": 1.0, "id": np.arange(18_000) // 3, "g": np.arange(18_000) % 2})
    df = spark.createDataFrame(pdf).repartition(5)
    group = None if id_col else "g"
    total = {0: 9000, 1: 9000} if group else 18_000
    wanted = forest.draw_samples(df, ["v", "w"], 6, 40, total, id_col=id_col, group=group)
    monkeypatch.setattr(forest, "THINNED_FROM", 10)
    thinned = forest.draw_samples(df, ["v", "w"], 6, 40, total, id_col=id_col, group=group)
    assert "BroadcastHashJoin" in thinned._jdf.queryExecution().toString()
    a, b = (sorted(map(tuple, d.collect())) for d in (wanted, thinned))
    assert a == b and len(a) == 6 * 40 * (2 if group else 1)


def test_squared_silhouette_equals_the_evaluator(spark):
    x = points(900)
    labels = np.arange(900) % 3
    labels[-1] = 3  # a cluster of one row
    df = clusters.assemble(spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(cluster=labels)), list("abc")).persist()
    wanted = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(df)
    counted = clusters.counted_vectors(df, "cluster")
    assert clusters.squared_silhouette(counted) == pytest.approx(wanted)
    assert clusters.squared_silhouette(df.select(F.array(*"abc").alias("x"), "cluster")) == pytest.approx(wanted)
    with pytest.raises(ValueError):
        clusters.squared_silhouette(counted.where("cluster = 0"))


def test_projection_from_moments_equals_the_fitted_one(spark):
    x = points(800)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    x[:, 2] += 0.5 * x[:, 0]
    x -= x.mean(axis=0)
    df = clusters.assemble(spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))), list("abc")).persist()
    (a, shares), (b, again) = clusters.project_2d(df, df), clusters.project_2d(df, df, clusters.vector_moments(clusters.counted_vectors(df)))
    assert shares == pytest.approx(again)
    a, b = (d.orderBy("a", "b", "c").select("pca_x", "pca_y").toPandas().to_numpy() for d in (a, b))
    assert np.allclose(a, b)


def test_cluster_job_does_not_hold_the_whole_table(spark):
    rows = spark.createDataFrame(pd.DataFrame(points(3000), columns=list("abc")).assign(note="x" * 50))
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    job = sg.cluster_job(rows, ["a", "b", "c"], 3, starts=2)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before
    assert job.clustered.count() == 3000 and {"note", "pca_x", "pca_y", "cluster"} <= set(job.clustered.columns)
    plan = job.clustered._jdf.queryExecution().toString()
    assert "InMemoryTableScan" not in plan


def test_a_single_quantile_counts_only_the_values_around_it(spark, monkeypatch):
    from millrace.operators import order_stats

    rng = np.random.default_rng(5)
    values = np.r_[rng.random(60_000).round(5), np.full(20_000, 0.5), rng.normal(0, 100, 10_000)]
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(4)
    kept = []
    durable = order_stats.durable
    monkeypatch.setattr(order_stats, "durable", lambda d: kept.append(durable(d)) or kept[-1])
    for prob in (0.0, 0.03, 0.5, 0.97, 0.99999, 1.0):
        kept.clear()
        got = order_stats.exact_quantiles(df, F.col("v"), [prob], direct_rows=100)[()][0]
        assert got == pytest.approx(np.quantile(values, prob), rel=1e-12)
        assert len(kept) == 1 and kept[0].count() < 500
    # Where the sketch misses the rank all values are counted.
    monkeypatch.setattr(order_stats, "_REACH", -0.2)
    assert order_stats.exact_quantiles(df, F.col("v"), [0.4], direct_rows=100)[()][0] == pytest.approx(np.quantile(values, 0.4))


def test_segmentation_holds_plain_columns_only(spark, monkeypatch):
    held = []
    cls = type(spark.range(1))
    persist = cls.persist
    monkeypatch.setattr(cls, "persist", lambda d, *a: held.append(d.columns) or persist(d, *a))
    monkeypatch.setattr(clusters, "COUNTED_ROWS", 100)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(0, 1, (600, 3)) + 6 * (np.arange(600) % 3)[:, None], columns=list("abc")).assign(note="x")
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    report = sg.run_segmentation(spark.createDataFrame(pdf), trees=5)
    assert report.k == 3 and report.scored.where("is_outlier").count() <= 18
    assert sorted(r["count"] for r in report.scored.groupBy("cluster").count().collect()) == [200, 200, 200]
    # The features once and the scores; no vectors, no second copy of the rows, nothing left behind.
    assert held == [["feature:a", "feature:b", "feature:c"], ["anomaly_score"]]
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before
