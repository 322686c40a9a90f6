"""Cross-validated boosted trees over counted cells (M5).

A boosted tree sees a row by the bin of each feature and its label alone.  Spark counts the
rows of a fold set by (fold, bins, label); the counts, bounded by the bins and not by the
rows, stand for all of them.  A search then fits each of its (trial, fold) models in a task
of its own, in place of a job per tree level.

The trees are those of Spark's ``GBTClassifier``: the same thresholds (of all rows, where Spark
looks at 10,000), log loss, first tree of weight 1, variance gain, leaf rules.  Subsampling
keeps each row of a cell with the same chance, so a cell's number of rows is a binomial draw;
single draws differ from Spark's, whose own depend on the order of the rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import quoted

# Python workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Distinct feature values per fold, and counted cells, that pass through the driver at most.
MAX_VALUES = 1_000_000
MAX_CELLS = 200_000
PURE = 2.0 ** -53  # Spark's bound for the impurity of a node that is not split


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Spark's split candidates of a continuous feature: between all distinct values, or where
    the running count is nearest to a multiple of an equal share."""
    n = float(counts.sum())
    wanted = int(min(bins, n)) - 1
    between = (values[1:] + values[:-1]) / 2.0
    if len(between) <= wanted:
        return between
    stride, target, out = n / (wanted + 1), n / (wanted + 1), []
    run = np.cumsum(counts).tolist()
    for i in range(1, len(values)):
        if abs(run[i - 1] - target) < abs(run[i] - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


def _best(stats: np.ndarray, starts: list[int], min_rows: int, min_gain: float, allowed: np.ndarray | None):
    """The best split of every node: gain, place, and (rows, sum, impurity) of both sides.

    ``stats`` holds rows, sums and sums of squares per node and bin, the features side by side."""
    ends = [*starts[1:], stats.shape[2]]
    left = np.concatenate([np.cumsum(stats[:, :, a:b], axis=2) for a, b in zip(starts, ends)], axis=2)
    total = left[:, :, ends[0] - 1]
    right = total[:, :, None] - left

    def impurity(x):
        n = np.maximum(x[0], 1)
        return np.where(x[0] > 0, (x[2] - x[1] * x[1] / n) / n, 0.0)

    li, ri = impurity(left), impurity(right)
    n = np.maximum(total[0], 1)[:, None]
    gain = impurity(total)[:, None] - left[0] / n * li - right[0] / n * ri
    valid = (left[0] >= min_rows) & (right[0] >= min_rows) & (gain >= min_gain)
    if allowed is not None:
        valid &= allowed
    gain = np.where(valid, gain, -np.inf)
    place = gain.argmax(axis=1)
    at = np.arange(len(place))
    side = [(x[0, at, place], x[1, at, place], i[at, place]) for x, i in ((left, li), (right, ri))]
    return gain[at, place], place, *side


def boosted_margins(binned: np.ndarray, sizes: Sequence[int], positive: np.ndarray, negative: np.ndarray, p: dict) -> np.ndarray:
    """Margin of every cell after all trees, fitted to ``positive`` and ``negative`` rows per cell.

    ``binned`` has a cell's bin of each feature, ``sizes`` the number of bins of each."""
    if not (positive + negative).any():
        raise ValueError("no rows to fit a model to")
    rng, (cells, n_features) = np.random.default_rng(p["seed"]), binned.shape
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int).tolist()
    width = int(sum(sizes))
    flat = binned + np.array(starts)  # place of the cell's bin among the bins of all features
    feature_of, first = np.repeat(np.arange(n_features), sizes), np.array(starts)
    subset = min(n_features, math.ceil(p["features"] * n_features))
    margin = np.zeros(cells)
    for m in range(p["trees"]):
        k = [rng.binomial(c, p["rate"]) if p["rate"] < 1 else c for c in (positive, negative)]
        r = (4 / (1 + np.exp(2 * margin)), -4 / (1 + np.exp(-2 * margin))) if m else (np.ones(cells), -np.ones(cells))
        rows = np.stack([k[0] + k[1], k[0] * r[0] + k[1] * r[1], k[0] * r[0] ** 2 + k[1] * r[1] ** 2]).astype(float)
        value = np.full(cells, rows[1].sum() / max(rows[0].sum(), 1))
        node, at, nodes = np.zeros(cells, np.int64), np.arange(cells), 1
        for _ in range(p["depth"]):
            keys = (node[:, None] * width + flat[at]).ravel()
            stats = np.stack([np.bincount(keys, np.repeat(x[at], n_features), nodes * width) for x in rows]).reshape(3, nodes, width)
            allowed = None
            if subset < n_features:
                chosen = rng.random((nodes, n_features)).argsort(axis=1) < subset
                allowed = chosen[:, feature_of]
            gain, place, left, right = _best(stats, starts, p["min_rows"], p["min_gain"], allowed)
            split = gain > 0
            if not split.any():
                break
            at, node = at[split[node]], node[split[node]]
            f = feature_of[place][node]
            goes = (binned[at, f] > (place[node] - first[f])).astype(np.int64)
            mean = np.stack([s[1] / np.maximum(s[0], 1) for s in (left, right)], axis=1)
            value[at] = mean[node, goes]
            # children that can be split again get the numbers of the next level
            grows = np.stack([split & (np.abs(s[2]) >= PURE) for s in (left, right)], axis=1).ravel()
            number = np.cumsum(grows) - 1
            child = 2 * node + goes
            kept = grows[child]
            at, node, nodes = at[kept], number[child[kept]], int(grows.sum())
            if not nodes:
                break
        margin += (p["step"] if m else 1.0) * value
    return margin


@dataclass
class FoldCells:
    """Counted rows of a two-class fold set; ``score`` fits on all folds but one in a task."""
    spark: SparkSession
    folds: list  # per fold: (bins of each cell, bins of each feature, rows per cell: train +, train -, test +, test -)

    def score(self, estimator, fold: int) -> float:
        """Accuracy on ``fold`` of the estimator's model of the others, NaN where the fold is empty."""
        strategy = estimator.getFeatureSubsetStrategy()
        p = {"trees": estimator.getMaxIter(), "step": estimator.getStepSize(), "depth": estimator.getMaxDepth(), "rate": estimator.getSubsamplingRate(), "seed": estimator.getSeed() % 2 ** 63,
             "features": 1.0 if strategy == "all" else float(strategy), "min_rows": estimator.getMinInstancesPerNode(), "min_gain": estimator.getMinInfoGain()}
        binned, sizes, (pos, neg, test_pos, test_neg) = self.folds[fold]

        def run(_):
            high = boosted_margins(binned, sizes, pos, neg, p) > 0
            right, n = int(test_pos[high].sum() + test_neg[~high].sum()), int((test_pos + test_neg).sum())
            return right / n if n else math.nan

        return self.spark.sparkContext.parallelize([fold], 1).map(run).first()


def fold_cells(data: DataFrame, features: str, label: str, k: int, bins: int) -> FoldCells | None:
    """The cells of (features, label, fold) rows, or None where Spark ML must fit the rows themselves:
    nominal features, labels other than 0 and 1, or more values or cells than the driver may hold."""
    attrs = data.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    names = attrs.get("numeric", [])
    if attrs.get("nominal") or attrs.get("binary") or not names:
        return None
    x, y, n_features = vector_to_array(features), quoted(label).cast("double"), len(names)
    rows = data.select("fold", y.alias("y"), *[x[j].alias(f"x{j}") for j in range(n_features)])
    columns = [f"x{j}" for j in range(n_features)]
    if rows.where(~F.coalesce(F.col("y").isin(0.0, 1.0), F.lit(False))).limit(1).count():
        return None
    values = rows.select("fold", F.posexplode(F.array(*columns)).alias("j", "v")).groupBy("fold", "j", "v").agg(F.count(F.lit(1)).alias("n")).limit(MAX_VALUES + 1).toPandas()
    if len(values) > MAX_VALUES or values["v"].isna().any():
        return None
    cuts = []
    for i in range(k):
        train = values[values["fold"] != i]
        by = train.groupby(["j", "v"], sort=True)["n"].sum().reset_index()
        cuts.append([thresholds(g["v"].to_numpy(), g["n"].to_numpy(), bins) for g in (by[by["j"] == j] for j in range(n_features))])
    # one count for all folds, by the bins between the thresholds of any of them
    merged = [np.unique(np.concatenate([c[j] for c in cuts])) for j in range(n_features)]

    def place(batches):
        for pdf in batches:
            yield pd.DataFrame({"fold": pdf["fold"], "y": pdf["y"], **{c: np.searchsorted(merged[j], pdf[c].to_numpy()).astype(np.int32) for j, c in enumerate(columns)}})

    schema = "fold int, y double, " + ", ".join(f"{c} int" for c in columns)
    placed = rows.withColumn("fold", F.col("fold").cast("int")).mapInPandas(place, schema)
    found = placed.groupBy("fold", "y", *columns).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CELLS + 1).toPandas()
    if len(found) > MAX_CELLS:
        return None
    found = found.sort_values(["fold", "y", *columns])  # draws follow the cells' order
    folds = []
    for i in range(k):
        own = np.stack([np.concatenate([np.searchsorted(cuts[i][j], merged[j]), [len(cuts[i][j])]])[found[c].to_numpy()] for j, c in enumerate(columns)], axis=1)
        binned, cell = np.unique(own, axis=0, return_inverse=True)
        tested, high = (found["fold"] == i).to_numpy(), (found["y"] == 1).to_numpy()
        counts = [np.bincount(cell.ravel(), found["n"].to_numpy() * keep, len(binned)).astype(np.int64) for keep in (~tested & high, ~tested & ~high, tested & high, tested & ~high)]
        folds.append((binned.astype(np.int64), [len(c) + 1 for c in cuts[i]], counts))
    return FoldCells(data.sparkSession, folds)
