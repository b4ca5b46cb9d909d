"""Regression trees over merged rows: one weighted row for each combination of bins of the features.

Splits lie between bins, so rows of equal bins are never parted: counts, sums and sums of
squares of the labels say all that a tree needs of them. Each tree is grown whole by one task
from the merged rows, which go to every machine; the caller bounds their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..tables import stored_folder

#: Merged rows that are looked at together.
CHUNK = 1 << 16


class Merged:
    """Bins (a row of bytes), number, label sum and label square sum of each merged row."""

    def __init__(self, bins: np.ndarray, n: np.ndarray, total: np.ndarray, squares: np.ndarray):
        self.bins, self.n, self.total, self.squares = bins, n, total, squares

    @classmethod
    def gather(cls, merged: DataFrame, bins: list[str]) -> Merged:
        """Of columns ``bins`` and ``n, total, squares``: all rows, on the driver."""
        t = merged.select(*bins, "n", "total", "squares").toArrow()
        values = np.empty((t.num_rows, len(bins)), np.uint8)
        for k, b in enumerate(bins):
            values[:, k] = t.column(b).to_numpy()
        return cls(values, *(t.column(c).to_numpy() for c in ("n", "total", "squares")))


def _level(rows: Merged, node: np.ndarray, tried: np.ndarray, n_bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and label sums by node, tried feature and bin, and square sums by node."""
    nodes, slots = tried.shape
    n, total, squares = np.zeros((slots, nodes * n_bins)), np.zeros((slots, nodes * n_bins)), np.zeros(nodes)
    width = rows.bins.shape[1]
    flat, features = rows.bins.ravel(), np.ascontiguousarray(tried.T)
    for k in range(0, len(node), CHUNK):
        own = node[k : k + CHUNK].astype(np.int64)
        cells, w, s, q = np.arange(k * width, (k + len(own)) * width, width), *(x[k : k + CHUNK] for x in (rows.n, rows.total, rows.squares))
        if own.min() < 0:
            at = np.flatnonzero(own >= 0)
            own, cells, w, s, q = own[at], cells[at], w[at], s[at], q[at]
        squares += np.bincount(own, q, minlength=nodes)
        w = w.astype(float)
        first = own * n_bins
        for j in range(slots):
            key = flat.take(cells + features[j].take(own)) + first
            n[j] += np.bincount(key, w, minlength=nodes * n_bins)
            total[j] += np.bincount(key, s, minlength=nodes * n_bins)
    return n.reshape(slots, nodes, n_bins), total.reshape(slots, nodes, n_bins), squares


def grow(rows: Merged, n_bins: int, slots: int, depth: int, seed: list[int]) -> pd.DataFrame:
    """The nodes of one tree, parents before children; ``feature`` is -1 at leaves, bins up to ``bin`` go to the left.

    Each node tries ``slots`` features chosen at random and takes the split that lowers the squared error most.
    """
    rng, out, first = np.random.default_rng(seed), [], 0
    node = np.zeros(len(rows.n), np.int16 if depth < 15 else np.int32)
    nodes = 1
    for level in range(depth + 1):
        tried = np.argsort(rng.random((nodes, rows.bins.shape[1])), axis=1)[:, :slots]
        n, total, squares = _level(rows, node, tried if level < depth else tried[:, :1], n_bins)
        all_n, all_total = n[0].sum(axis=1), total[0].sum(axis=1)
        left_n, left_total = n.cumsum(axis=2)[:, :, :-1], total.cumsum(axis=2)[:, :, :-1]
        right_n, right_total = all_n[:, None] - left_n, all_total[:, None] - left_total
        parts = (left_n > 0) & (right_n > 0)
        base = all_total * all_total / all_n
        lower = np.where(parts, left_total * left_total / np.where(parts, left_n, 1) + right_total * right_total / np.where(parts, right_n, 1) - base[:, None], -np.inf)
        best = lower.transpose(1, 0, 2).reshape(nodes, -1)
        pick = best.argmax(axis=1)
        gain = best[np.arange(nodes), pick]
        inner = (gain > 1e-12 * base) if level < depth else np.zeros(nodes, bool)
        feature = np.where(inner, tried[np.arange(nodes), pick // (n_bins - 1)], -1)
        cut = pick % (n_bins - 1)
        rank = np.cumsum(inner) - 1
        left = np.where(inner, first + nodes + 2 * rank, -1)
        out.append(pd.DataFrame({
            "id": np.arange(first, first + nodes), "n": all_n, "total": all_total, "squares": squares, "gain": np.where(inner, gain / all_n, -1.0),
            "feature": feature, "bin": cut, "left": left, "right": np.where(inner, left + 1, -1),
        }))
        if not inner.any():
            break
        width, flat, child = rows.bins.shape[1], rows.bins.ravel(), np.where(inner, 2 * rank, -2)
        tested = np.maximum(feature, 0)
        for k in range(0, len(node), CHUNK):
            own = node[k : k + CHUNK]
            now = own.astype(np.int64)
            cells = np.arange(k * width, (k + len(own)) * width, width)
            # Below 0 are rows whose leaf is reached: they look at the last node and stay.
            right = flat.take(cells + tested[now]) > cut[now]
            own[:] = np.where(now < 0, -1, np.maximum(child[now] + right, -1))
        first, nodes = first + nodes, 2 * int(inner.sum())
    return pd.concat(out)


def fit(spark: SparkSession, rows: Merged, edges: list[np.ndarray], forest: RandomForestRegressor) -> RandomForestRegressionModel:
    """Trees of the settings of ``forest`` over all merged rows, each without a bootstrap, as a model of values.

    ``edges`` are those of the features' bins: a value's bin is the number of edges up to it.
    """
    ship(spark)
    trees, depth, width = forest.getNumTrees(), forest.getMaxDepth(), rows.bins.shape[1]
    slots = -(-width // 3) if trees > 1 else width
    seed, n_bins = forest.getSeed(), max(2, *(len(e) + 1 for e in edges))
    shared = spark.sparkContext.broadcast(rows)
    # A value is in a bin up to k if it is below edge k.
    below = [np.nextafter(e, -np.inf) for e in edges]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["id"].tolist():
                told = grow(shared.value, n_bins, slots, depth, [seed, tree])
                value = [below[f][min(k, len(below[f]) - 1)] if f >= 0 else 0.0 for f, k in zip(told["feature"], told["bin"], strict=True)]
                yield told.drop(columns="bin").assign(tree=tree, value=value)

    names = "tree int, id int, n double, total double, squares double, gain double, feature int, value double, left int, right int"
    grown = spark.range(0, trees, 1, trees).mapInPandas(run, names)
    path = stored_folder(spark)
    # A forest of the same settings over two rows gives the form in which Spark stores one.
    form = spark.createDataFrame([(Vectors.dense([0.0] * width), y) for y in (0.0, 1.0)], [forest.getFeaturesCol(), forest.getLabelCol()])
    forest.copy().setBootstrap(False).fit(form).write().save(f"{path}/form")
    mean = F.col("total") / F.col("n")
    inner = F.col("feature") >= 0
    split = F.struct(F.col("feature").alias("featureIndex"), F.when(inner, F.array("value")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    node = F.struct(
        "id", mean.alias("prediction"), F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)).alias("impurity"), F.array("n", "total", "squares").alias("impurityStats"),
        F.col("n").cast("long").alias("rawCount"), "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"),
    )
    stored = spark.read.parquet(f"{path}/form/data").schema
    grown.select(F.col("tree").alias("treeID"), node.alias("nodeData")).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in stored]).write.parquet(f"{path}/grown/data")
    shared.destroy()
    spark.read.parquet(f"{path}/form/treesMetadata").write.parquet(f"{path}/grown/treesMetadata")
    spark.read.text(f"{path}/form/metadata").write.text(f"{path}/grown/metadata")
    return RandomForestRegressionModel.load(f"{path}/grown")
