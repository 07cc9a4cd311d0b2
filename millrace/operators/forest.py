"""Isolation forest: trees grown on bounded samples in parallel tasks, every row scored in place.

MLlib has no such model. A tree sees at most 256 rows, so growing it is a bounded grouped map; the
node table of the whole forest is a few thousand rows and travels to the tasks as flat arrays.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.values import quoted
from millrace.operators.order_stats import exact_quantiles
from millrace.operators.trees import from_nodes

SAMPLE_ROWS = 256
# Tables of more rows are thinned before their equal rows are counted, by the totals of so many hash buckets at most.
THINNED_FROM = 1_000_000
_BUCKETS = 1 << 17
_NODES = "tree int, node int, feature int, cut double, left int, right int, path double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(tree: int, rows: np.ndarray, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng([seed, tree])
    deepest = math.ceil(math.log2(max(len(rows), 2)))
    nodes: list[list] = []
    work = [(rows, 0, None, None)]
    while work:
        part, depth, parent, side = work.pop()
        here = len(nodes)
        if parent is not None:
            nodes[parent][side] = here
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= deepest or len(part) <= 1 or not len(usable):
            nodes.append([-1, 0.0, -1, -1, depth + average_path(len(part))])
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= cut
        nodes.append([feature, cut, -1, -1, 0.0])
        work.append((part[~goes_left], depth + 1, here, 3))
        work.append((part[goes_left], depth + 1, here, 2))
    table = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "path"])
    table.insert(0, "node", np.arange(len(nodes)))
    table.insert(0, "tree", tree)
    return table


@dataclass(frozen=True)
class IsolationForest:
    features: tuple[str, ...]
    sample_rows: int
    nodes: pd.DataFrame

    def score(self, df: DataFrame, output: str = "anomaly_score") -> DataFrame:
        """Anomaly score in (0, 1) per row, higher is stranger; all trees of a block of rows are walked together, no shuffle."""
        depth = math.ceil(math.log2(max(self.sample_rows, 2)))
        paths = from_nodes(self.nodes.rename(columns={"path": "value"}), np.ones(self.nodes["tree"].nunique()), depth)
        norm, trees = average_path(self.sample_rows) or 1.0, len(paths.roots)

        @F.pandas_udf("double")
        def walk(*values: pd.Series) -> pd.Series:
            x = np.column_stack([v.to_numpy(dtype="float64") for v in values])
            return pd.Series(np.exp2(-paths.predict(x) / trees / norm))

        return df.withColumn(output, walk(*[quoted(c).cast("double") for c in self.features]))


def _dealt(batch: pd.DataFrame, columns: list[str], trees: int, share: float | np.ndarray, seed: int) -> pd.DataFrame:
    """(tree, draw, features) of the copies that a tree may draw.

    A vector stands for ``copies`` rows, each with a draw of its own in each tree; those under ``share`` are wanted. Their number is
    binomial over all its (row, tree) cells: small ones by inversion of the uniform number that let the vector pass, large ones by a
    generator seeded by the vector. Which cells they are is drawn without replacement, so trees and copies are treated alike.
    """
    cells = batch["copies"].to_numpy(dtype=np.int64) * trees
    share = np.broadcast_to(np.asarray(share, dtype=float), len(batch))
    u, luck = batch["u"].to_numpy(), batch["luck"].to_numpy(dtype=np.int64).view(np.uint64)
    expected = cells * share
    hits = np.zeros(len(batch), np.int64)
    low = np.flatnonzero((expected <= 20) & (share < 1))
    if len(low):
        n, odds = cells[low].astype(float), share[low] / (1 - share[low])
        mass = np.exp(n * np.log1p(-share[low]))
        reached, open_ = np.zeros(len(low)), np.ones(len(low), bool)
        k = 0
        while open_.any() and k < 400:
            mass = mass * np.maximum(n - k, 0) / (k + 1) * odds
            k += 1
            reached += mass
            hits[low[open_]] = k
            open_ &= (reached <= u[low]) & (k < n)
    row, cell, draw = [], [], []
    one = np.flatnonzero(hits == 1)
    if len(one):
        # The common case: a single cell, from the vector's second hash alone.
        row.append(one)
        cell.append((luck[one] >> np.uint64(20)).astype(np.int64) % cells[one])
        draw.append(((luck[one] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / float(1 << 53))
    for i in np.flatnonzero(hits != 1).tolist():
        rng = np.random.default_rng([seed, int(luck[i])])
        n = int(cells[i])
        many = n if share[i] >= 1 else int(hits[i]) or int(rng.binomial(n, share[i]))
        row.append(np.full(many, i))
        cell.append(np.arange(n) if many == n else rng.choice(n, many, replace=False))
        draw.append(rng.random(many))
    if not row:
        return pd.DataFrame({"tree": np.zeros(0, np.int32), "draw": np.zeros(0), **{c: np.zeros(0) for c in columns}})
    rows = np.concatenate(row)
    found = batch[columns].iloc[rows].reset_index(drop=True)
    found.insert(0, "draw", np.concatenate(draw) * share[rows])
    found.insert(0, "tree", (np.concatenate(cell) % trees).astype(np.int32))
    return found


def draw_samples(
    df: DataFrame, features: Sequence[str], trees: int, size: int, total: int | dict, seed: int = 42, id_col: str | None = None,
    group: str | None = None, copies: str | None = None, distinct: bool = False,
) -> DataFrame:
    """(``tree``, ``draw``, ``f0``, ``f1`` ...): a uniform sample of ``size`` rows without replacement for each tree.

    Equal rows are counted first; the rest works on vectors with their counts, so a vector with a third of all rows fills about a third
    of each sample. One hash decides whether a vector is drawn at all, and all draws depend on its values (and the id), not on the
    partitioning. A large table is thinned before the count: the rows of a hash bucket are at least the copies of each of its vectors, so
    a vector whose hash is not small enough for that many copies is in no sample, and only the others are shuffled. A tree has about twice ``size`` candidates, of which the smallest draws win. With ``group``, an integer column, every
    group has samples of its own (column ``group``), and ``total`` gives the rows of each. ``copies`` names the column of a frame whose
    rows stand for so many equal ones; ``distinct`` says that no two of its rows are equal.
    """
    columns = [f"f{i}" for i in range(len(features))]
    named = [quoted(c).cast("double").alias(f) for c, f in zip(features, columns)]
    known = ([quoted(id_col).cast("string").alias("id")] if id_col else []) + [(quoted(group) if group else F.lit(0)).cast("int").alias("group")]
    keys = [*columns, *(["id"] if id_col else []), "group"]
    totals = total if group else {0: total}
    shares = {g: 1.0 if n <= 4 * size else 2.0 * size / n for g, n in totals.items()}
    many = (quoted(copies) if copies else F.lit(1)).cast("bigint").alias("copies")
    # A generator, so that the filters that follow don't repeat the expressions behind the columns.
    plain = df.select(F.inline(F.array(F.struct(*named, *known, many))))
    # Beside an id the values only tell rows that share it apart; as floats they are free of the noise of sums in another order.
    told = [F.col("group"), *([F.col("id"), *[F.col(c).cast("float") for c in columns]] if id_col else [F.col(c) for c in columns])]
    bits = F.shiftrightunsigned(F.xxhash64(*told, F.lit(seed)), 11).cast("double") / float(2**53)

    def chance(copies: Column) -> Column:
        some = F.lit(1.0)
        for g, share in shares.items():
            if share < 1:
                some = F.when(F.col("group") == g, -F.expm1(copies * trees * F.lit(math.log1p(-share)))).otherwise(some)
        return some

    rows = sum(totals.values())
    if rows > THINNED_FROM and min(shares.values()) < 1 and not distinct:
        buckets = min(_BUCKETS, max(1, rows // SAMPLE_ROWS))
        placed = plain.withColumn("place", F.pmod(F.xxhash64(*told, F.lit(seed), F.lit(2)), F.lit(buckets)))
        most = placed.groupBy("place").agg(F.sum("copies").alias("most"))  # one row per bucket
        plain = placed.join(F.broadcast(most), "place").where(bits < chance(F.col("most"))).drop("place", "most")
    counted = plain if distinct else plain.groupBy(*keys).agg(F.sum("copies").alias("copies"))
    passed = counted.withColumns({"u": bits, "luck": F.xxhash64(*told, F.lit(seed), F.lit(1))}).where(F.col("u") < chance(F.col("copies")))

    def deal(batches):
        for batch in batches:
            if len(batch):
                yield _dealt(batch, [*columns, "group"], trees, batch["group"].map(shares).to_numpy(dtype=float), seed)

    schema = ", ".join(["tree int", "draw double", *[f"{c} double" for c in columns], "group int"])
    candidates = passed.select(*columns, "group", "copies", "u", "luck").mapInPandas(deal, schema)
    # A tree's candidates are about twice its sample, whatever the table holds.
    first = Window.partitionBy("group", "tree").orderBy("draw", *columns)
    placed = candidates.withColumn("place", F.row_number().over(first)).where(F.col("place") <= size).drop("place")
    return placed if group else placed.drop("group")


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    trees: int = 10,
    seed: int = 42,
    id_col: str | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> IsolationForest:
    """Grow ``trees`` trees on up to 256 rows each, drawn by :func:`draw_samples`.

    The trees grow in parallel tasks; the node table (at most trees x 511 rows) is collected once, so scoring uses one fixed forest.
    """
    total = df.count()
    size = min(sample_rows, total)
    sample = draw_samples(df, features, trees, size, total, seed, id_col)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("draw")
        rows = ordered[[f"f{i}" for i in range(len(features))]].to_numpy()
        return _grow(int(ordered["tree"].iloc[0]), rows, seed)

    return IsolationForest(tuple(features), size, sample.groupBy("tree").applyInPandas(grow, _NODES).toPandas())


def flag_outliers(
    scored: DataFrame, contamination: float, score: str = "anomaly_score", fitted: DataFrame | None = None
) -> tuple[DataFrame, float]:
    """Flag scores strictly above the (1 - contamination) quantile of the fit rows (exact quantile)."""
    cut = exact_quantiles(scored if fitted is None else fitted, F.col(score), [1 - contamination])[()][0]
    return scored.withColumn("is_outlier", F.col(score) > cut), cut
