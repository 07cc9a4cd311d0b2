"""K-Means of many starts, stored centres, and landing rules on a frame."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from millrace.operators import clusters
from millrace.sources import landing, sinks


def lloyd(x, centres, max_iter, tol):
    for _ in range(max_iter):
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        fresh = np.array([x[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        moved, centres = ((fresh - centres) ** 2).sum(), fresh
        if moved <= tol:
            break
    return centres, ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


@pytest.fixture(scope="module")
def points():
    # Without groups, so that the runs end in different places.
    return np.random.default_rng(5).uniform(-10, 10, size=(540, 3))


def frame(spark, x, parts=5):
    return clusters.assemble(spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).repartition(parts), list("abc")).persist()


def test_runs_side_by_side_equal_single_ones(spark, points, monkeypatch):
    first = {}
    draw = clusters._first_centres

    def noted(sample, k, rng):
        found = draw(sample, k, rng)
        first.setdefault(k, []).append(found)
        return found

    monkeypatch.setattr(clusters, "_first_centres", noted)
    found = clusters.kmeans_of_starts(frame(spark, points), [3, 9], starts=10, max_iter=40, tol=1e-6)
    for k, starts in first.items():
        ends = [lloyd(points, c, 40, 1e-6) for c in starts]
        best = min(ends, key=lambda e: e[1])
        assert len(starts) == 10 and found[k].cost == pytest.approx(best[1])
        assert np.allclose(sorted(map(tuple, found[k].clusterCenters())), sorted(map(tuple, best[0])))
    # Some starts end worse than the best: a single one would not do.
    assert max(lloyd(points, c, 40, 1e-6)[1] for c in first[9]) > 1.01 * found[9].cost


def test_starts_do_not_depend_on_the_partitioning(spark, points):
    a = clusters.kmeans_of_starts(frame(spark, points, 2), [4], 3, max_iter=10)[4]
    b = clusters.kmeans_of_starts(frame(spark, points[::-1], 7), [4], 3, max_iter=10)[4]
    assert np.allclose(a.points, b.points)


def test_centres_assign_and_store(spark, points, tmp_path):
    df = frame(spark, points)
    found = clusters.kmeans_of_starts(df, [4], 2)[4]
    sinks.save_centres(found, str(tmp_path / "c"), spark)
    assert sinks.load_centres(str(tmp_path / "c"), spark) == found
    rows = found.transform(df).select("a", "b", "c", "cluster").toPandas()
    gaps = ((rows[list("abc")].to_numpy()[:, None] - np.array(found.points)[None]) ** 2).sum(axis=2)
    assert (rows["cluster"] == gaps.argmin(axis=1)).all()


def test_few_distinct_rows_and_none(spark):
    same = frame(spark, np.ones((30, 3)))
    assert clusters.kmeans_of_starts(same, [3])[3].points == ((1.0, 1.0, 1.0),)
    with pytest.raises(ValueError):
        clusters.kmeans_of_starts(same.limit(0), [3])


def test_large_files_are_not_vouched_for(spark):
    files = spark.createDataFrame(
        [("land/a.txt", 3_000_000_000, None, None, None, None), ("land/b.txt", 1, bytearray(b"x"), None, None, None)],
        "path string, length bigint, content binary, mime string, longest_line bigint, parquet_rows bigint",
    )
    got = {r["name"]: (r["accepted"], r["status"]) for r in landing.judge(files).collect()}
    assert got == {"a.txt": (False, 202), "b.txt": (True, 200)}
    assert {r["status"] for r in landing.judge(files, landing.UPLOAD).where(F.col("name") == "a.txt").collect()} == {413}


def test_equal_rows_are_met_once_with_their_copies(spark):
    points = np.random.default_rng(9).normal(size=(60, 3)).repeat(np.arange(60) % 7 + 1, axis=0)
    df = frame(spark, points, 5)
    counted = clusters.counted_vectors(df)
    assert counted.count() == 60 and counted.agg(F.sum("copies")).first()[0] == len(points)
    sets = [points[:3].copy() + 0.1, points[::50][:4]]
    rows = df.select(vector_to_array("features").alias("x"))
    a, b = ({(r["at"], r["cluster"]): (r["n"], r["cost"], *r["total"]) for r in clusters.centre_sums(f, sets).collect()} for f in (rows, counted))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    gap = ((points[:, None] - sets[0][None]) ** 2).sum(axis=2)
    assert sum(v[1] for k, v in b.items() if k[0] == 0) == pytest.approx(gap.min(axis=1).sum())
    held = clusters.Centres(tuple(map(tuple, sets[1]))).transform(df)
    exact = clusters.euclidean_silhouette(held.select("features", "cluster"))
    assert clusters.silhouette(held, rows=512).value == pytest.approx(exact)
