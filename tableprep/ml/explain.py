"""Explanations: importances (M10, O3), coefficient extremes (O4), linear
attribution (M11) and tree attribution (M12).

Linear attribution is a set of column expressions for every row.  Tree
attribution computes exact path-dependent Shapley values (``tree_paths`` has
the method).  Rows are processed by ``mapInPandas`` on the executors; only the
ensemble's flat arrays are broadcast, and their size is checked.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark import cloudpickle

from ..functions.names import quoted
from ..session import default_parallelism, scratch_path
from .tree_paths import attributor, flat_bytes, flatten

# The per-row work runs in Python workers that need not have this package
# installed: ship this module's functions with the task by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of equal features are explained once, where at most one in SAME_GAIN rows is distinct and
# the contributions of these fit a broadcast (values: rows x classes x columns).
SAME_GAIN = 4
SAME_VALUES = 2_000_000

# An ensemble's arrays go to every executor: at most this many bytes (28 a node, so 38 million nodes).
MAX_TREE_BYTES = 1 << 30


def feature_importance(model, names: Sequence[str], top: int = 20) -> DataFrame:
    """Normalised split-gain importances, top ``top`` descending."""
    spark = __import__("pyspark.sql", fromlist=["SparkSession"]).SparkSession.getActiveSession()
    imp = model.featureImportances.toArray().tolist()
    df = spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)], "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(top)


def coefficient_extremes(coefs: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest and ``k`` smallest coefficients, ascending,
    each feature once (D20).  ``coefs`` has (feature, coefficient)."""
    body = coefs.where(~F.col("feature").startswith("(intercept)"))
    top = body.orderBy(F.col("coefficient").desc(), "feature").limit(k)
    bottom = body.orderBy(F.col("coefficient").asc(), "feature").limit(k)
    return top.unionByName(bottom).distinct().orderBy("coefficient", "feature")


def linear_attribution(df: DataFrame, coefficients: dict[str, float], intercept: float,
                       means: dict[str, float], keep: Sequence[str] = ()) -> DataFrame:
    """Contribution of feature f = coef_f * (x_f - training mean of f);
    base value = intercept + sum coef_f * mean_f; base + sum of contributions
    equals the (linear, or log-odds) prediction of every row."""
    base = intercept + sum(coefficients[f] * means.get(f, 0.0) for f in coefficients)
    contrib = [(F.lit(c) * (quoted(f).cast("double") - F.lit(means.get(f, 0.0)))).alias(f"{f}_contrib")
               for f, c in coefficients.items()]
    return df.select(*map(quoted, keep), *contrib, F.lit(base).alias("base_value"))


def multinomial_attribution(df: DataFrame, matrix, intercepts, features: Sequence[str], means: dict[str, float], keep: Sequence[str] = ()) -> DataFrame:
    """M11 of a model with several classes: one row per input row and class.

    A class's log-odds are taken against the mean over classes, which a softmax does not
    notice: with the coefficient matrix and intercepts centred over classes, the
    contribution of feature f to class k is ``w_kf * (x_f - mean_f)``, the base value is
    ``b_k + sum w_kf * mean_f``, and base plus contributions is the class's ``margin``,
    whose softmax over classes is the predicted probability.  Columns: ``keep``, ``class``,
    ``<feature>_contrib``, ``base_value``, ``margin``.  Column expressions only, exploded
    over the classes."""
    w = np.asarray(matrix, float)
    b = np.asarray(intercepts, float)
    w, b = w - w.mean(axis=0), b - b.mean()
    centre = np.array([means.get(f, 0.0) for f in features])
    base = b + w @ centre
    x = [quoted(f).cast("double") for f in features]

    def of_class(k: int):
        parts = [F.lit(float(w[k, j])) * (x[j] - F.lit(float(centre[j]))) for j in range(len(features))]
        # the margin is taken from the raw values, so that the sum of the parts can be held against it
        margin = sum((F.lit(float(w[k, j])) * x[j] for j in range(len(features))), F.lit(float(b[k])))
        return F.struct(F.lit(k).alias("class"), *[p.alias(f"p{j}") for j, p in enumerate(parts)], F.lit(float(base[k])).alias("base_value"), margin.alias("margin"))

    out = df.select(*map(quoted, keep), F.explode(F.array(*[of_class(k) for k in range(len(b))])).alias("__class"))
    names = [F.col("__class").getField(f"p{j}").alias(f"{f}_contrib") for j, f in enumerate(features)]
    return out.select(*map(quoted, keep), F.col("__class.class").alias("class"), *names, F.col("__class.base_value").alias("base_value"), F.col("__class.margin").alias("margin"))


# --- tree attribution ------------------------------------------------------------

def _gbt_trees(model) -> tuple[list[dict], list[float]]:
    """Read the fitted ensemble as node tables through its saved form (the
    only public route to per-node training counts).  A node's count is the weight of its
    training rows, as rows of equal features may be fitted as one (``grouped_rows``)."""
    spark = __import__("pyspark.sql", fromlist=["SparkSession"]).SparkSession.getActiveSession()
    path = scratch_path(spark, "gbt-structure")
    model.write().overwrite().save(path)
    weights = dict(enumerate(float(w) for w in model.treeWeights))
    nodes = spark.read.parquet(os.path.join(path, "data")).select(
        "treeID", "nodeData.id", "nodeData.prediction", F.col("nodeData.impurityStats")[0].alias("rawCount"), "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
        "nodeData.split.numCategories").collect()
    trees: dict[int, dict] = {}
    for r in nodes:
        trees.setdefault(r["treeID"], {})[r["id"]] = r.asDict()
    ids = sorted(trees)
    return [trees[t] for t in ids], [weights[t] for t in ids]


def tree_attribution(df: DataFrame, model, feature_cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Per row, the Shapley contribution of every feature to the raw
    ensemble output (regression prediction, or classification margin) and
    the base value; base + sum of contributions = raw output, for every row.

    A multiclass model (``OneVsRest`` of boosted ensembles) gives one row per
    input row and class, with a ``class`` column; each class row explains
    that class's one-vs-rest margin.  All classes run in one pass.

    ``df`` must hold the prepared numeric feature columns (e.g. the output of
    ``TreeFeatures.transform``).  Where few of its rows are distinct in them (binned numbers,
    categories), these are explained and joined to all rows."""
    if hasattr(model, "treeWeights"):
        ensembles, multiclass = [model], False
    elif hasattr(model, "models") and all(hasattr(m, "treeWeights") for m in model.models):
        ensembles, multiclass = list(model.models), True
    else:
        raise ValueError("tree attribution needs a boosted ensemble, or a one-vs-rest set of them")
    flats = [flatten(*_gbt_trees(m)) for m in ensembles]
    size = sum(map(flat_bytes, flats))
    if size > MAX_TREE_BYTES:
        raise ValueError(f"the trees take {size:,} bytes as arrays; MAX_TREE_BYTES allows {MAX_TREE_BYTES:,}")
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast({"flats": flats})
    feats = list(feature_cols)
    keep = list(keep)
    same = [quoted(f).cast("double").alias(f"__same{i}") for i, f in enumerate(feats)]
    size = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*same))).first() if feats else (0, 0)
    if feats and size[1] * SAME_GAIN <= size[0] and size[1] * len(ensembles) * (2 * len(feats) + 2) <= SAME_VALUES:
        return _explained_once(df, shared, feats, keep, same, multiclass)
    return _explained(df, shared, feats, keep, multiclass)


def _explained_once(df: DataFrame, shared, feats: list[str], keep: list[str], same: list, multiclass: bool) -> DataFrame:
    """Contributions of the distinct feature rows, joined back to all rows."""
    keys = [f"__same{i}" for i in range(len(feats))]
    distinct = df.select(*same).distinct()
    found = _explained(distinct, shared, keys, keys, multiclass)
    contributions = [F.col(f"{k}_contrib").alias(f"__c{i}") for i, k in enumerate(keys)]
    table = found.select(*[F.col(k).alias(f"__at{i}") for i, k in enumerate(keys)], *([F.col("class").alias("__class")] if multiclass else []), *contributions, F.col("base_value").alias("__base"))
    rows = df.select(*[quoted(c).alias(f"__keep{i}") for i, c in enumerate(keep)], *same)
    # NULLs, NaN and both zeros meet their like
    on = [F.col(f"__same{i}").eqNullSafe(F.col(f"__at{i}")) for i in range(len(feats))]
    out = rows.join(F.broadcast(table), on)
    return out.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], *([F.col("__class").alias("class")] if multiclass else []),
                      *[F.col(f"__c{i}").alias(f"{f}_contrib") for i, f in enumerate(feats)], F.col("__base").alias("base_value"))


def _explained(df: DataFrame, shared, feats: list[str], keep: list[str], multiclass: bool) -> DataFrame:
    """Contributions of every row by itself."""
    spark = df.sparkSession
    names = [f"{f}_contrib" for f in feats]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*map(quoted, keep)).schema.fields]
                       + (["`class` int"] if multiclass else [])
                       + [f"`{n}` double" for n in names] + ["base_value double"])

    def run(batches):
        held = shared.value  # stays in the worker, and the tables made so far with it
        if "attribute" not in held:
            held["attribute"] = attributor(held["flats"])
        for pdf in batches:
            x = pdf[feats].to_numpy(dtype=float)
            for ci, (out, base) in enumerate(held["attribute"](x, len(feats))):
                res = pdf[keep].copy() if keep else pd.DataFrame(index=pdf.index)
                if multiclass:
                    res["class"] = np.int32(ci)
                for j, n in enumerate(names):
                    res[n] = out[:, j]
                res["base_value"] = base
                yield res

    cols = keep + [f for f in feats if f not in keep]
    rows = df.select(*map(quoted, cols))
    # The per-row work is CPU-heavy Python: deal the (narrow) feature rows out first.
    return rows.repartition(max(default_parallelism(spark), spark.sparkContext.defaultParallelism)).mapInPandas(run, schema)
