"""K-Means with a silhouette choice of K, and the two-dimensional projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import quoted
from millrace.operators.forest import draw_samples
from millrace.operators.matrix import ColumnFacts, PairMoments, pair_moments

# The starts are drawn from a sample of this many rows; all rows decide where the centres go.
START_ROWS = 4096
CANDIDATES = (2, 3, 4, 5, 6)
FALLBACK_K = 4
SILHOUETTE_MIN = 0.40
_REPLICATES, _T95 = 8, 2.365
# Rows are counted by value where the table is small or a value has this many rows on average.
COUNTED_ROWS, _LEAST_COPIES = 1_000_000, 4
# Runs of more iterations than this pack the rows: rows of a leaf, leaves of a stem, rows of a block.
_PACKED_FROM, _LEAF, _STEM, _BLOCK = 20, 32, 32, 1 << 20


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    # VectorAssembler reads dots in names as struct access.
    safe = {c: f"_v{i}" for i, c in enumerate(features)}
    view = df.withColumns({s: F.col("`" + c.replace("`", "``") + "`").cast("double") for c, s in safe.items()})
    return VectorAssembler(inputCols=list(safe.values()), outputCol=output).transform(view).drop(*safe.values())


def kmeans(df: DataFrame, k: int, seed: int = 42, max_iter: int = 5, tol: float = 0.05) -> KMeansModel:
    return KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="features", predictionCol="cluster").fit(df)


@dataclass(frozen=True)
class Centres:
    """Fitted cluster centres; ``transform`` adds ``cluster``, the place of the nearest one (the first on a tie)."""

    points: tuple[tuple[float, ...], ...]
    cost: float | None = None

    def clusterCenters(self) -> list[np.ndarray]:
        return [np.array(p) for p in self.points]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.nearest(df.withColumn("_x", vector_to_array("features")), "_x").drop("_x")

    def nearest(self, df: DataFrame, array: str) -> DataFrame:
        x = F.col(array)
        gaps = [sum(((x[i] - v) * (x[i] - v) for i, v in enumerate(p)), F.lit(0.0)) for p in self.points]
        held = df.withColumn("_gaps", F.array(*gaps))
        return held.withColumn("cluster", (F.array_position("_gaps", F.array_min("_gaps")) - 1).cast("int")).drop("_gaps")


def counted_vectors(df: DataFrame, *keys: str) -> DataFrame:
    """``x`` (the vector of ``features`` as an array), ``keys`` and ``copies``, the rows that hold them: what equal rows share is done once."""
    rows = df.select(vector_to_array("features").alias("x"), *keys)
    return rows.groupBy("x", *keys).agg(F.count(F.lit(1)).alias("copies"))


def weighed_vectors(df: DataFrame, columns: Sequence[str], rows: int) -> DataFrame:
    """``x`` (the values of ``columns``) and ``copies``: each distinct row once, held, where that is far fewer than the ``rows``; else ``x`` of
    every row, as counting would shuffle and hold the whole table. The values in a 64th of the hashes decide."""
    flat = df.select(*[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    x = F.array(*flat.columns).alias("x")
    kinds = rows
    if rows > COUNTED_ROWS:
        some = flat.where(F.pmod(F.xxhash64(*flat.columns), F.lit(64)) == 0).groupBy(*flat.columns).agg(F.count(F.lit(1)).alias("copies"))
        seen = some.agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("rows")).first()
        kinds = 64 * seen["kinds"]
        if seen["kinds"] * _LEAST_COPIES > (seen["rows"] or 0):
            return flat.select(x)
    counted = flat.groupBy(*flat.columns).agg(F.count(F.lit(1)).alias("copies"))
    if kinds > _BLOCK // 16:
        # Adaptive execution would leave them in few tasks.
        counted = counted.repartition(max(df.sparkSession.sparkContext.defaultParallelism, kinds // _BLOCK), *flat.columns)
    return counted.select(x, "copies").persist()


def _copies(rows: DataFrame) -> Column:
    return F.col("copies") if "copies" in rows.columns else F.lit(1).cast("bigint")


def vector_moments(rows: DataFrame) -> PairMoments:
    """Moments of the dimensions of :func:`weighed_vectors`."""
    names = [f"x{i}" for i in range(len(rows.first()["x"]))]
    plain = {n: ColumnFacts(0, 0.0, 1.0, None, None) for n in names}
    flat = rows.select(*[F.col("x")[i].alias(n) for i, n in enumerate(names)], _copies(rows).alias("copies"))
    return pair_moments(flat, names, plain, F.col("copies"))


def _vectors(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """An array column of a batch as a matrix."""
    held = batch.column(batch.schema.get_field_index(name))
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def packed_vectors(rows: DataFrame) -> DataFrame:
    """Rows ``x`` (and ``copies``) as blocks of leaves, for many scans: :func:`centre_sums` takes a leaf as a whole where one centre is nearest to all of it.

    A task sorts about a million rows at a time by the interleaved bits of their ranks in each dimension; 32 rows in a row are a leaf, 32 leaves a
    stem. A block has ``points`` and ``copies`` (the last leaf filled up with rows of no copies; no bytes where each row has one copy) and the
    ``facts`` of its leaves: least and largest value and sum in each dimension, rows, sum of squares.
    """

    def block(parts):
        x, w = (np.concatenate(held) for held in zip(*parts))
        x, w = (np.concatenate([v, np.repeat(v[-1:], -len(v) % _LEAF, axis=0)]) for v in (x, w))
        real = sum(len(p) for p, _ in parts)
        w[real:] = 0.0
        dims = x.shape[1]
        bits = min(62 // dims, int(np.ceil(np.log2(len(x)) / dims)) + 1)
        code = np.zeros(len(x), np.int64)
        for i in range(dims):
            rank = np.empty(len(x), np.int64)
            rank[np.argsort(x[:, i], kind="stable")] = np.arange(len(x))
            level = (rank << bits) // len(x)
            for b in range(bits):
                code |= ((level >> b) & 1) << (b * dims + i)
        order = np.argsort(code, kind="stable")
        x, w = x[order].reshape(-1, _LEAF, dims), w[order].reshape(-1, _LEAF)
        squares = ((x**2).sum(axis=2) * w).sum(axis=1)
        facts = np.column_stack([x.min(axis=1), x.max(axis=1), (x * w[:, :, None]).sum(axis=1), w.sum(axis=1), squares])
        held = [x.tobytes(), b"" if (w == 1).all() else w.tobytes(), facts.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *(pa.array([h], pa.binary()) for h in held)], names=["dims", "points", "copies", "facts"])

    def pack(batches):
        parts, size = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append((_vectors(batch), batch.column(1).to_numpy().astype(float)))
                size += batch.num_rows
            if size >= _BLOCK:
                yield block(parts)
                parts, size = [], 0
        if parts:
            yield block(parts)

    return rows.select("x", _copies(rows).alias("copies")).mapInArrow(pack, "dims int, points binary, copies binary, facts binary")


def _whole(low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre nearest to the middle of each box, and whether it is the nearest one to every point of the box."""
    own = np.stack([(((low + high) / 2 - c) ** 2).sum(axis=1) for c in centres], axis=1).argmin(axis=1)
    norms = (centres**2).sum(axis=1)
    # What rounding could turn is left to the rows.
    slack = 1e-9 * (norms.max() + (np.maximum(np.abs(low), np.abs(high)) ** 2).sum(axis=1))
    whole = np.ones(len(own), bool)
    for a in range(len(centres)):
        at = np.flatnonzero(own == a)
        for b in range(len(centres)):
            if a != b and len(at):
                step = 2 * (centres[b] - centres[a])
                whole[at] &= np.where(step > 0, high[at], low[at]) @ step < norms[b] - norms[a] - slack[at]
    return own, whole


def centre_sums(rows: DataFrame, sets: Sequence[np.ndarray]) -> DataFrame:
    """``at`` (set), ``cluster``, ``n``, ``cost`` and ``total`` of the rows nearest to each centre of each set of centres.

    ``rows`` has the array column ``x``, and ``copies`` if a row stands for several, or holds :func:`packed_vectors`. All sets share one scan: a
    task adds up its Arrow batches, and one row per set and centre leaves it.
    """
    packed = "points" in rows.columns
    weighed = "copies" in rows.columns
    sizes = [len(c) for c in sets]
    dims = sets[0].shape[1]

    def add_up(batches):
        n, cost = [np.zeros(k) for k in sizes], [np.zeros(k) for k in sizes]
        total = [np.zeros((k, dims)) for k in sizes]

        def count(s, own, w, weighted, gaps):
            n[s] += np.bincount(own, w, minlength=sizes[s])
            cost[s] += np.bincount(own, gaps, minlength=sizes[s])
            total[s] += np.stack([np.bincount(own, v, minlength=sizes[s]) for v in weighted], axis=1)

        def count_rows(s, held, copies):
            for a in range(0, len(held), 8192):
                x, w = held[a : a + 8192], copies[a : a + 8192]
                columns = np.ascontiguousarray(x.T)
                gap = np.stack([sum((v - p) ** 2 for v, p in zip(columns, c)) for c in sets[s]])
                own = gap.argmin(axis=0)
                count(s, own, w, columns * w, gap[own, np.arange(len(x))] * w)

        def count_whole(s, facts, centres):
            low, high, sums, w, squares = np.split(facts, [dims, 2 * dims, 3 * dims, 3 * dims + 1], axis=1)
            own, whole = _whole(low, high, centres)
            own, sums, w = own[whole], sums[whole], w[whole, 0]
            gaps = squares[whole, 0] - 2 * (sums * centres[own]).sum(axis=1) + w * (centres[own] ** 2).sum(axis=1)
            count(s, own, w, sums.T, np.maximum(gaps, 0.0))
            return np.flatnonzero(~whole)

        for batch in batches:
            if not packed and batch.num_rows:
                held = _vectors(batch)
                copies = batch.column(1).to_numpy().astype(float) if weighed else np.ones(len(held))
                for s in range(len(sets)):
                    count_rows(s, held, copies)
            for i in range(batch.num_rows if packed else 0):
                points, copies, facts = (np.frombuffer(batch.column(c)[i].as_buffer()) for c in range(3))
                points, facts = points.reshape(-1, _LEAF, dims), facts.reshape(-1, 3 * dims + 2)
                copies = copies.reshape(-1, _LEAF) if len(copies) else None
                first = np.arange(0, len(facts), _STEM)
                stems = np.column_stack([
                    np.minimum.reduceat(facts[:, :dims], first), np.maximum.reduceat(facts[:, dims : 2 * dims], first), np.add.reduceat(facts[:, 2 * dims :], first),
                ])
                for s, centres in enumerate(sets):
                    open_ = count_whole(s, stems, centres)
                    leaves = (first[open_, None] + np.arange(_STEM)).ravel()
                    leaves = leaves[leaves < len(facts)]
                    leaves = leaves[count_whole(s, facts[leaves], centres)]
                    rest = points[leaves].reshape(-1, dims)
                    count_rows(s, rest, np.ones(len(rest)) if copies is None else copies[leaves].ravel())
        found = [(s, c, n[s][c], cost[s][c], total[s][c].tolist()) for s, k in enumerate(sizes) for c in range(k) if n[s][c]]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, f)) for f in found], schema)

    schema = pa.schema([("at", pa.int32()), ("cluster", pa.int32()), ("n", pa.float64()), ("cost", pa.float64()), ("total", pa.list_(pa.float64()))])
    seen = ["points", "copies", "facts"] if packed else ["x", *(["copies"] if weighed else [])]
    parts = rows.select(*seen).mapInArrow(add_up, "at int, cluster int, n double, cost double, total array<double>")
    return parts.groupBy("at", "cluster").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total")
    )


def _first_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ on a sample; fewer than ``k`` centres when the sample has fewer distinct rows."""
    chosen = [sample[rng.integers(len(sample))]]
    gap = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and gap.sum() > 0:
        chosen.append(sample[rng.choice(len(sample), p=gap / gap.sum())])
        gap = np.minimum(gap, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def kmeans_of_starts(
    df: DataFrame, ks: Sequence[int], starts: int = 1, seed: int = 42, max_iter: int = 5, tol: float = 0.05, start_rows: int = START_ROWS,
    counted: DataFrame | None = None,
) -> dict[int, Centres]:
    """The best of ``starts`` runs of Lloyd's iteration for every K, by the cost over all rows.

    All runs of all K advance together, one scan of the rows (``counted`` if the caller has them as :func:`weighed_vectors`) an iteration; many
    iterations scan them packed, which takes most leaves of neighbours as a whole. A run ends when its centres move by a squared
    distance of ``tol`` in all. The k-means++ starts come from a sample of ``start_rows`` rows drawn by counted vectors, so they do not depend on the
    partitioning. A centre without rows stays where it is. The rows must have no missing value; an empty table is refused.
    """
    rows = counted_vectors(df).persist() if counted is None else counted
    size = rows.agg(F.sum(_copies(rows))).first()[0]
    if not size:
        raise ValueError("No rows to cluster.")
    dims = len(rows.first()["x"])
    wide = rows.select(*[F.col("x")[i].alias(f"x{i}") for i in range(dims)], _copies(rows).alias("copies"))
    distinct = "copies" in rows.columns
    drawn = draw_samples(wide, [f"x{i}" for i in range(dims)], 1, min(start_rows, size), size, seed, copies="copies", distinct=distinct).toPandas()
    columns = [f"f{i}" for i in range(dims)]
    sample = drawn.sort_values(["draw", *columns])[columns].to_numpy()
    runs = [(k, s) for k in ks for s in range(starts)]
    centres = [_first_centres(sample, k, np.random.default_rng([seed, k, s])) for k, s in runs]
    moving = list(range(len(runs)))
    scanned = packed_vectors(rows).persist() if max_iter > _PACKED_FROM else rows
    for _ in range(max_iter):
        found = centre_sums(scanned, [centres[r] for r in moving]).collect()  # one row per run and centre
        fresh = {r: centres[r].copy() for r in moving}
        for f in found:
            fresh[moving[f["at"]]][f["cluster"]] = np.array(f["total"]) / f["n"]
        moved = {r: float(((fresh[r] - centres[r]) ** 2).sum()) for r in moving}
        for r in moving:
            centres[r] = fresh[r]
        moving = [r for r in moving if moved[r] > tol]
        if not moving:
            break
    costs: dict[int, float | None] = dict.fromkeys(range(len(runs)))
    if starts > 1:
        costs = dict.fromkeys(range(len(runs)), 0.0)
        for f in centre_sums(scanned, centres).collect():
            costs[f["at"]] += f["cost"]
    if scanned is not rows:
        scanned.unpersist()
    if counted is None:
        rows.unpersist()
    best = {k: min((r for r, (own, _) in enumerate(runs) if own == k), key=lambda r: (costs[r] or 0.0, r)) for k in ks}
    return {k: Centres(tuple(tuple(map(float, c)) for c in centres[r]), costs[r]) for k, r in best.items()}


def centroid_order(model: KMeansModel | Centres) -> Column:
    """Cluster number after sorting the centroids, so that numbering does not depend on the seed."""
    centers = [tuple(c) for c in model.clusterCenters()]
    rank = {old: new for new, old in enumerate(sorted(range(len(centers)), key=lambda i: centers[i]))}
    return F.element_at(F.array(*[F.lit(rank[i]) for i in range(len(centers))]), F.col("cluster") + 1)


def draw_order(df: DataFrame, id_col: str | None, seed: int) -> Column:
    """A draw that depends on the row alone: on its id, or without one on all its plain columns."""
    names = [id_col] if id_col else [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant", "udt")]
    plain = ["`" + n.replace("`", "``") + "`" for n in names]
    return F.xxhash64(*[F.col(n) for n in plain], F.lit(seed))


def hash_sample(df: DataFrame, rows: int, id_col: str | None = None, seed: int = 42) -> DataFrame:
    """Uniform sample of ``rows`` rows: the smallest draws, by a top-k and not a sort."""
    return df.withColumn("_draw", draw_order(df, id_col, seed)).orderBy("_draw").limit(rows).drop("_draw")


def euclidean_silhouette(sample: DataFrame) -> float | None:
    """Mean Euclidean silhouette of a bounded sample with columns features and cluster.

    The sample (a few hundred rows) is sent to the tasks; each row meets it in an Arrow batch, so no
    pairs are written out. None when fewer than two clusters are present.
    """
    rows = sample.select(vector_to_array("features").alias("x"), "cluster")
    held = rows.toPandas()
    if held["cluster"].nunique() < 2:
        return None
    points, labels = np.stack(held["x"].to_numpy()), held["cluster"].to_numpy()
    names = np.unique(labels)
    member = labels[:, None] == names[None, :]
    sizes = member.sum(axis=0)

    def widths(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_numpy())
            own = np.searchsorted(names, batch["cluster"].to_numpy())
            gap = np.sqrt(((x[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
            sums = gap @ member
            line = np.arange(len(x))
            peers = sizes[own] - 1
            inner = sums[line, own] / np.maximum(peers, 1)
            mean = sums / sizes
            mean[line, own] = np.inf
            outer = mean.min(axis=1)
            top = np.maximum(inner, outer)
            width = np.where((peers > 0) & (top > 0), (outer - inner) / np.where(top > 0, top, 1), 0.0)
            yield pd.DataFrame({"width": width})

    spread = sample.sparkSession.createDataFrame(held).repartition(8)
    return spread.mapInPandas(widths, "width double").agg(F.avg("width")).first()[0]


def squared_silhouette(counted: DataFrame) -> float:
    """Silhouette of all rows under squared Euclidean distance, which needs no pairs, from ``x``, ``cluster`` and, if any, ``copies``.

    The value is that of MLlib's evaluator on the single rows (which takes a weight for one row, not for copies).
    """
    x, w = F.col("x"), _copies(counted).cast("double")
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    dims = len(counted.first()["x"])
    held = counted.groupBy("cluster").agg(F.sum(w).alias("n"), F.sum(w * square).alias("square"), *[F.sum(w * x[i]).alias(f"t{i}") for i in range(dims)])
    stats = {r["cluster"]: r for r in held.collect()}  # one row per cluster
    if len(stats) < 2:
        raise ValueError("A silhouette needs two clusters.")

    def mean_gap(r):
        return square + r["square"] / r["n"] - 2.0 * sum((x[i] * (r[f"t{i}"] / r["n"]) for i in range(dims)), F.lit(0.0))

    width = F.lit(0.0)
    for c, r in stats.items():
        if r["n"] > 1:
            inner = mean_gap(r) * (r["n"] / (r["n"] - 1))
            outer = F.array_min(F.array(*[mean_gap(o) for d, o in stats.items() if d != c]))
            own = F.when(inner < outer, 1 - inner / outer).when(inner > outer, outer / inner - 1).otherwise(0.0)
            width = F.when(F.col("cluster") == c, own).otherwise(width)
    total = sum(r["n"] for r in stats.values())
    return counted.agg(F.sum(width * w)).first()[0] / total


@dataclass(frozen=True)
class Silhouette:
    """Mean Euclidean silhouette of all rows with its 95 % interval; exact when both ends are the value."""

    value: float
    low: float
    high: float

    def decides(self, limit: float) -> bool:
        return not self.low < limit <= self.high


def _against_samples(counted: DataFrame, sizes: dict[int, int], rows: int, seed: int) -> Silhouette:
    names = sorted(sizes)
    dims = len(counted.first()["x"])
    flat = counted.select("x", "cluster", _copies(counted).alias("copies"))
    distinct = "copies" in counted.columns
    wide = flat.select(*[F.col("x")[i].alias(f"x{i}") for i in range(dims)], "cluster", "copies")
    held = draw_samples(wide, [f"x{i}" for i in range(dims)], _REPLICATES, rows, sizes, seed, group="cluster", copies="copies", distinct=distinct).toPandas()
    # In order of (replicate, cluster), so that the sums of distances of each are sums of neighbours.
    place = held["tree"].to_numpy() * len(names) + np.searchsorted(names, held["group"].to_numpy())
    order = np.argsort(place, kind="stable")
    points = held[[f"f{i}" for i in range(dims)]].to_numpy()[order]
    starts = np.searchsorted(place[order], np.arange(_REPLICATES * len(names)))
    counts = np.diff(np.append(starts, len(points))).astype(float).reshape(_REPLICATES, len(names))
    full = np.array([sizes[c] for c in names], dtype=float)
    norms = (points**2).sum(axis=1)

    def widths(sums: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
        line, mean = np.arange(len(own)), sums / n
        # A sample may hold the row itself, as its cluster does: the mean over the others follows from the mean over all.
        inner = mean[line, own] * full[own] / np.maximum(full[own] - 1, 1)
        mean[line, own] = np.inf
        outer = mean.min(axis=1)
        top = np.maximum(inner, outer)
        return np.where((full[own] > 1) & (top > 0), (outer - inner) / np.where(top > 0, top, 1.0), 0.0)

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            every, clusters, copies = _vectors(batch), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(float)
            for a in range(0, len(every), 1024):
                x, own, w = every[a : a + 1024], np.searchsorted(names, clusters[a : a + 1024]), copies[a : a + 1024]
                gap = x @ (-2 * points.T)
                gap += (x**2).sum(axis=1)[:, None] + norms[None, :]
                np.sqrt(np.maximum(gap, 0.0, out=gap), out=gap)
                sums = np.add.reduceat(gap, starts, axis=1).reshape(len(x), _REPLICATES, len(names))
                found = [widths(sums.sum(axis=1), counts.sum(axis=0), own)] + [widths(sums[:, g], counts[g], own) for g in range(_REPLICATES)]
                yield pa.RecordBatch.from_arrays([pa.array([float((v * w).sum())]) for v in found], names=[f"w{g}" for g in range(_REPLICATES + 1)])

    schema = ", ".join(f"w{g} double" for g in range(_REPLICATES + 1))
    row = flat.mapInArrow(score, schema).agg(*[F.sum(f"w{g}").alias(f"w{g}") for g in range(_REPLICATES + 1)]).first()
    value, *others = np.array(list(row)) / full.sum()
    # Student's t for one less than the number of replicates.
    reach = 0.0 if rows >= max(sizes.values()) else _T95 * float(np.std(others, ddof=1)) / _REPLICATES**0.5
    return Silhouette(float(value), float(value - reach), float(value + reach))


def silhouette(df: DataFrame, limit: float | None = None, rows: int = 32, most: int = 4096, seed: int = 42) -> Silhouette | None:
    """Mean Euclidean silhouette of all rows of ``features`` and ``cluster``, and its interval.

    Every row meets a sample of each cluster (``rows`` rows in each of eight replicates, drawn by counted vectors) in an Arrow batch, so no
    pairs are written and nothing but the samples is sent around. The replicates give the interval. While it holds ``limit`` the samples
    are doubled, up to ``most`` rows a replicate; samples that hold every row are exact. None with fewer than two clusters. Equal rows
    meet the samples once.
    """
    counted = counted_vectors(df, "cluster").persist()
    found = counted_silhouette(counted, limit, rows, most, seed)
    counted.unpersist()
    return found


def counted_silhouette(counted: DataFrame, limit: float | None = None, rows: int = 32, most: int = 4096, seed: int = 42) -> Silhouette | None:
    """:func:`silhouette` of distinct rows ``x`` with their ``cluster`` and ``copies``, or of single rows without ``copies``."""
    held = counted.groupBy("cluster").agg(F.sum(_copies(counted)).alias("n")).collect()  # one row per cluster
    sizes = {int(r["cluster"]): int(r["n"]) for r in held}
    if len(sizes) < 2:
        return None
    while True:
        found = _against_samples(counted, sizes, rows, seed)
        if limit is None or found.decides(limit) or rows >= max(sizes.values()) or 2 * rows > most:
            return found
        rows *= 2


def choose_k(
    fit: DataFrame, rows: int, id_col: str | None = None, seed: int = 42, sample_rows: int | None = None, counted: DataFrame | None = None
) -> tuple[int, str, dict[int, float], Centres, dict[int, Silhouette]]:
    """Best silhouette over K = 2..6 when it reaches 0.40, else 4; under 20 rows K is clamped.

    The silhouette is the Euclidean one of all rows (:func:`silhouette`), whose samples are doubled for the best K until the interval
    leaves 0.40 out; ``sample_rows`` asks for that of a sample of rows instead. The last value holds the intervals. ``counted`` are the
    rows as :func:`weighed_vectors` if the caller has them.
    """
    if rows < 20:
        k = max(2, min(4, max(1, rows - 1)))
        return k, "fallback_default", {}, kmeans_of_starts(fit, [k], seed=seed)[k], {}
    held = None
    if sample_rows:
        sample = hash_sample(fit.select("features", *([id_col] if id_col else [])), min(sample_rows, rows), id_col, seed)
        held = sample.sparkSession.createDataFrame(sample.toPandas(), sample.schema)  # at most sample_rows rows
    tried = [k for k in CANDIDATES if k < rows]
    # What follows sees each distinct row once, with its copies.
    own = counted is None
    counted = counted_vectors(fit).persist() if own else counted
    models = kmeans_of_starts(fit, tried, seed=seed, counted=counted)

    def judge(k: int) -> tuple[float | None, Silhouette | None]:
        if held is not None:
            return euclidean_silhouette(models[k].transform(held)), None
        found = counted_silhouette(models[k].nearest(counted, "x"), seed=seed)
        return None if found is None else found.value, found

    # The evaluations do not depend on each other; their jobs share the cluster, as in MLlib's own tuning.
    with ThreadPool(len(tried)) as pool:
        outcomes = dict(zip(tried, pool.map(inheritable_thread_target(fit.sparkSession)(judge), tried)))
    scores = {k: o[0] for k, o in outcomes.items() if o[0] is not None}
    spans = {k: o[1] for k, o in outcomes.items() if o[1] is not None}
    best = max(scores, key=lambda k: (round(scores[k], 4), -k), default=None)
    if best in spans and not spans[best].decides(SILHOUETTE_MIN):
        spans[best] = counted_silhouette(models[best].nearest(counted, "x"), SILHOUETTE_MIN, 64, seed=seed)
        scores[best] = spans[best].value
    if own:
        counted.unpersist()
    scores = {k: round(v, 4) for k, v in scores.items()}
    if best is not None and scores[best] >= SILHOUETTE_MIN:
        return best, "data_driven_silhouette", scores, models[best], spans
    return FALLBACK_K, "fallback_default", scores, models[FALLBACK_K], spans


def project_2d(fit: DataFrame, df: DataFrame, moments: PairMoments | None = None) -> tuple[DataFrame, list[float]]:
    """First two principal components of standardised features as pca_x, pca_y; variance shares.

    MLlib does not centre before projecting, so ``features`` must be centred. The sign is fixed so
    that the largest loading of a component is positive. ``moments`` of the standardised columns, taken without assembling a vector per
    row, give the components in place of ``fit``.
    """
    if moments is None:
        size = len(fit.first()["features"])
        model = PCA(k=min(2, size), inputCol="features", outputCol="_pc").fit(fit)
        loads, shares = model.pc.toArray(), [float(v) for v in model.explainedVariance]
    else:
        size, n = len(moments.n), moments.n[0, 0]
        spread, axes = np.linalg.eigh((moments.product - moments.value * moments.value.T / n) / max(n - 1, 1))
        loads = axes[:, ::-1][:, : min(2, size)]
        shares = [float(v / spread.sum()) for v in spread[::-1][: min(2, size)]]
    signs = [1.0 if loads[np.abs(loads[:, j]).argmax(), j] >= 0 else -1.0 for j in range(loads.shape[1])]
    if moments is None:
        flat, parts = model.transform(df), vector_to_array("_pc")
    else:
        x = F.col("_x")
        flat = df.withColumn("_x", vector_to_array("features"))
        flat = flat.withColumn("_pc", F.array(*[sum((x[i] * float(v) for i, v in enumerate(loads[:, j])), F.lit(0.0)) for j in range(loads.shape[1])])).drop("_x")
        parts = F.col("_pc")
    flat = flat.withColumns({
        "pca_x": parts[0] * signs[0], "pca_y": parts[1] * signs[1] if size > 1 else F.lit(0.0),
    })
    return flat.drop("_pc"), shares
