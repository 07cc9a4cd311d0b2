"""Fitted tree ensembles as flat node arrays: predictions of many rows, and of the first trees alone, inside Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.values import quoted
from millrace.session import shared_folder

# Cells (rows x trees) that are walked at a time.
_CELLS = 1 << 20
# Rows of a training task at least.
_TASK_ROWS = 20_000


@dataclass(frozen=True)
class TreeEnsemble:
    """Nodes of all trees in a row; a leaf points at itself, so that walking on from it changes nothing."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Node that each row reaches in each tree (rows x trees); a value at or under the cut goes left."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        line = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[line, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return node

    def staged(self, x: np.ndarray, stages: Sequence[int]) -> np.ndarray:
        """Predictions of the first so many trees, a column per stage."""
        out = np.empty((len(x), len(stages)))
        step = max(1, _CELLS // max(1, len(self.roots)))
        ends = np.asarray(stages) - 1
        for a in range(0, len(x), step):
            out[a : a + step] = np.cumsum(self.value[self.leaves(x[a : a + step])] * self.weights, axis=1)[:, ends]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.staged(x, [len(self.roots)])[:, 0]


def fit_trees(data: DataFrame, **params) -> GBTRegressionModel:
    """A boosted model of ``features`` and ``label``. Every round is several passes over the rows, so they are held, in few partitions
    where they are few: a task's start costs more than some ten thousand rows."""
    held = data.persist()
    rows, parts = held.count(), held.rdd.getNumPartitions()
    ready = held.coalesce(min(parts, max(1, rows // _TASK_ROWS))).persist()
    try:
        return GBTRegressor(**params).fit(ready)
    finally:
        ready.unpersist()
        held.unpersist()


def from_nodes(nodes: pd.DataFrame, weights: Sequence[float], depth: int) -> TreeEnsemble:
    """An ensemble from a table ``tree, node, feature, cut, left, right, value``; a leaf has feature -1."""
    nodes = nodes.sort_values(["tree", "node"])
    sizes = nodes.groupby("tree")["node"].count().to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    shift, at, inner = np.repeat(starts, sizes), np.arange(len(nodes)), nodes["feature"].to_numpy() >= 0
    return TreeEnsemble(
        np.maximum(nodes["feature"].to_numpy(), 0).astype(np.int64), nodes["cut"].to_numpy(dtype=float),
        np.where(inner, nodes["left"].to_numpy() + shift, at), np.where(inner, nodes["right"].to_numpy() + shift, at),
        nodes["value"].to_numpy(dtype=float), starts, np.asarray(weights, dtype=float), depth,
    )


def from_boosted(model: GBTRegressionModel, spark: SparkSession) -> TreeEnsemble:
    """The node arrays of a boosted model, read from the table in which it is stored (trees x nodes, bounded by its settings)."""
    path = f"{shared_folder(spark)}/boosted-{os.urandom(8).hex()}"
    model.write().save(path)
    split = F.col("nodeData.split")
    table = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), split["featureIndex"].alias("feature"),
        F.coalesce(F.get(split["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("cut"), F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"), F.col("nodeData.prediction").alias("value"), split["numCategories"].alias("kinds"),
    ).toPandas()
    if (table["kinds"] >= 0).any():
        raise ValueError("splits by category are not supported")
    leaf = table["left"] < 0
    table.loc[leaf, "feature"] = -1
    return from_nodes(table, model.treeWeights, max(t.depth for t in model.trees))


def predict_staged(df: DataFrame, ensemble: TreeEnsemble, features: Sequence[str], stages: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``stages`` (array of predictions of the first so many trees) of every row, in one pass without a shuffle."""
    fields = [df.select(quoted(c)).schema.fields[0] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["stages array<double>"])
    inputs = [quoted(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]

    def walk(batches):
        for batch in batches:
            x = batch[[f"_x{i}" for i in range(len(features))]].to_numpy(dtype=float)
            found = batch[list(keep)].copy()
            found["stages"] = list(ensemble.staged(x, stages)) if len(x) else []
            yield found

    return df.select(*[quoted(c) for c in keep], *inputs).mapInPandas(walk, schema)
