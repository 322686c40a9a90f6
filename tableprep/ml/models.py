"""Model fitting and scoring on Spark ML.

* OLS (M1): ``LinearRegression`` with the normal-equation solver: one
  distributed aggregation of X'X / X'y, exact for narrow data.
* Logistic (M2): ``LogisticRegression`` with ``regParam = 1 / (C * n)``,
  no elastic net and no standardisation, so the objective equals the
  summed-loss L2 objective with inverse strength ``C``.
* Gradient-boosted trees (M3): ``GBTRegressor`` / ``GBTClassifier``; more
  than two classes -> ``OneVsRest``.  Parameter names follow the reference
  (SURVEY 2.13) and are mapped here.
"""

from __future__ import annotations

import json
import math
import os
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..functions.stats import column_quantiles
from .features import LabelEncoderModel, _present, category_key, fit_label_encoder

FEATURES = "features"

# GBDT defaults of the reference form.
GBT_DEFAULTS = {
    "n_estimators": 100,
    "learning_rate": 0.1,
    "max_depth": 7,
    "num_leaves": 31,
    "subsample": 0.8,
    "colsample_bytree": 0.8,
    "reg_alpha": 0.0,
    "reg_lambda": 1.0,
    "random_state": 42,
}
SPARK_MAX_DEPTH = 30


def assemble(df: DataFrame, features: Sequence[str], out: str = FEATURES,
             handle_invalid: str = "error") -> DataFrame:
    """Feature columns -> one vector column.  ``handle_invalid`` is D17:
    'error' (default: a NULL fails the job), 'skip' (drop the row) or 'keep'."""
    cols = [c for c in features]
    va = VectorAssembler(inputCols=cols, outputCol=out, handleInvalid=handle_invalid)
    return va.transform(df)


# Rows of equal features are fitted as weighted rows where that leaves at most one in GROUP_GAIN.
# Each such group stays apart in GROUP_UNITS parts, which subsampling draws in place of rows.
GROUP_UNITS = 8
GROUP_GAIN = 4
WEIGHT, UNIT = "__weight", "__unit"


def row_unit(df: DataFrame) -> Column:
    """Part of its group that a row belongs to: a hash of the whole row."""
    hashable = [quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(F.lit(UNIT), *hashable), F.lit(GROUP_UNITS)).cast("int")


def grouped_rows(data: DataFrame, label: str, task: str, keys: Sequence[str] = ()) -> DataFrame | None:
    """Assembled (features, label, unit, ``keys``) rows with equal features as one weighted row
    each, or None where few features repeat (continuous ones, small tables).

    Boosted trees see a row by its features alone, so nothing is lost: squared errors are
    fitted to the mean label of equal rows with their number as weight, as what its labels
    spread around the mean adds the same to every split; classes are kept apart by label.
    Every row counts.  Subsampling draws a group's units, GROUP_UNITS parts of its rows."""
    x = vector_to_array(FEATURES)
    by = [quoted(label)] if task != "regression" else [quoted(label).isNull().alias("__none")]
    size = data.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(x, *by, *map(quoted, keys)))).first()
    if size[1] * GROUP_UNITS * GROUP_GAIN > size[0]:
        return None
    mean = [] if task != "regression" else [F.avg(quoted(label).cast("double")).alias(label)]
    found = data.groupBy(x.alias("__x"), *by, UNIT, *map(quoted, keys)).agg(*mean, F.count(F.lit(1)).cast("double").alias(WEIGHT))
    vector = array_to_vector("__x").alias(FEATURES, metadata=data.schema[FEATURES].metadata)
    return found.select(vector, quoted(label), *map(quoted, keys), WEIGHT)


def training_set(df: DataFrame, features: Sequence[str], label: str, handle_invalid: str = "error", n_rows: int | None = None) -> DataFrame:
    """Assembled (features, label) rows, persisted: iterative learners read
    their input once per iteration.  Memory and disk, so it spills instead
    of failing, and a lost executor's blocks are recomputed from lineage."""
    data = assemble(df, features, handle_invalid=handle_invalid).select(FEATURES, label)
    return spread(data, n_rows).persist(StorageLevel.MEMORY_AND_DISK)


# Rows of so many bins are fitted by their bins from here on, where that groups them: below, continuous features stay as they are.
BIN_ROWS = 200_000
GROUPS_PER_TASK = 50_000

# Boosted fits hold about 220 bytes a row in the blocks that a task reads: at most 450 MB.
ROWS_PER_TASK = 2_000_000


def spread(data: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Rows dealt out for an iterative learner.

    A few large row groups would leave cores idle for every iteration, and more
    partitions than cores only add tasks to it: AQE spreads the cached set once,
    to one partition per core, fewer for small sets.  Above ``ROWS_PER_TASK`` rows a core
    (of ``n_rows``, where that is known) every core gets as many partitions as that
    takes; AQE, which counts compressed bytes, would put them together again."""
    cores = data.sparkSession.sparkContext.defaultParallelism
    rounds = -(-(n_rows or 0) // (cores * ROWS_PER_TASK))
    return data.repartition(cores * rounds) if rounds > 1 else data.hint("rebalance", cores)


def fit_ols(df: DataFrame, features: Sequence[str], label: str, handle_invalid: str = "error"):
    """M1: ordinary least squares with intercept.  Up to 4,096 features the
    normal solver aggregates X'X and X'y in one pass, so the input is not
    cached; wider data goes to L-BFGS."""
    data = assemble(df, features, handle_invalid=handle_invalid)
    lr = LinearRegression(featuresCol=FEATURES, labelCol=label, solver="auto", regParam=0.0,
                          elasticNetParam=0.0, fitIntercept=True, standardization=False)
    return lr.fit(data)


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, C: float = 1.0,
                 max_iter: int = 100, handle_invalid: str = "error", n_rows: int | None = None):
    """M2: L2-regularised logistic regression (binary or multinomial)."""
    data = training_set(df, features, label, handle_invalid)
    n = n_rows if n_rows is not None else data.count()
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=label, regParam=1.0 / (C * max(n, 1)),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, family="auto",
                            tol=1e-8)
    try:
        return lr.fit(data)
    finally:
        data.unpersist()


# Parameters the GBDT form must carry, each a positive number.
REQUIRED_GBT_PARAMS = ("learning_rate", "n_estimators", "max_depth")


def validate_model_parameters(params: Mapping) -> bool:
    """Every required parameter present, numeric (not boolean) and > 0."""
    for name in REQUIRED_GBT_PARAMS:
        v = params.get(name) if isinstance(params, Mapping) else None
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not v > 0:
            return False
    return True


def gbt_params(params: Mapping | None = None, cap_leaves: bool = False) -> dict:
    """Map reference GBDT parameters to Spark ``GBT*`` parameters (2.13).

    Spark grows trees level by level, so it cannot stop at a number of leaves.
    ``cap_leaves`` caps the depth at the last level that a tree of at most ``num_leaves``
    leaves can fill."""
    p = dict(GBT_DEFAULTS)
    p.update(params or {})
    for k in ("reg_alpha", "reg_lambda"):
        if float(p[k]) != float(GBT_DEFAULTS[k]):
            raise ValueError(f"{k} has no Spark counterpart; tune minInfoGain / minInstancesPerNode instead")
    depth = int(p["max_depth"])
    if depth < 0 or depth > SPARK_MAX_DEPTH:
        warnings.warn(f"max_depth {depth} is grown to Spark's limit of {SPARK_MAX_DEPTH}", stacklevel=2)
        depth = SPARK_MAX_DEPTH
    leaves = (params or {}).get("num_leaves")
    if leaves is not None and cap_leaves:
        depth = min(depth, max(1, math.floor(math.log2(max(int(leaves), 2)))))
    elif leaves is not None:
        warnings.warn("num_leaves has no effect: Spark grows trees level by level; max_depth bounds them, or cap_leaves", stacklevel=2)
    col = float(p["colsample_bytree"])
    return {
        "maxIter": int(p["n_estimators"]),
        "stepSize": float(p["learning_rate"]),
        "maxDepth": depth,
        "subsamplingRate": float(p["subsample"]),
        "featureSubsetStrategy": "all" if col >= 1.0 else repr(col),
        "seed": int(p["random_state"]),
    }


# Categorical features with more values than this get no bin per value: their categories
# are put in the order of a target statistic instead (``TargetOrder``).
NOMINAL_CATEGORIES = 1_000
ORDER_FOLDS = 5
ORDER_WEIGHT = 10.0  # rows that the overall mean counts as in a category's statistic


@dataclass
class TargetOrder:
    """Categories of a wide column, ordered by their mean target.

    ``table`` holds a row per value: the text value, its rows ``n`` and target sum ``s``, and
    the same per fold of the training rows.  A value's number is its mean, drawn to the overall
    mean as by ``ORDER_WEIGHT`` rows; missing and unseen values get the overall mean.  A
    training row's number leaves the rows of its own fold out, so its label is not in its
    feature.  Folds are a hash of the whole row, so rows that differ in any column (an id, say)
    fall into different ones.  A category all of whose training rows are in one fold counts
    as unseen there."""
    table: DataFrame
    mean: float
    rows: int
    nbytes: int

    def _joined(self, df: DataFrame, key: Column, i: int) -> DataFrame:
        from .features import DICTIONARY_BROADCAST_BYTES, DICTIONARY_BROADCAST_ROWS
        table = self.table.select(F.col("value").alias(f"__tov{i}"), F.struct("n", "s", "folds").alias(f"__to{i}"))
        if self.rows <= DICTIONARY_BROADCAST_ROWS and self.nbytes <= DICTIONARY_BROADCAST_BYTES:
            table = F.broadcast(table)
        return df.withColumn(f"__tok{i}", key).join(table, F.col(f"__tok{i}") == F.col(f"__tov{i}"), "left")

    def number(self, i: int, fold: Column | None) -> Column:
        got, w = F.col(f"__to{i}"), F.lit(ORDER_WEIGHT)
        n, s = got["n"], got["s"]
        if fold is not None:
            own = F.try_element_at(got["folds"], fold.cast("int"))
            n, s = n - F.coalesce(own["n"], F.lit(0)), s - F.coalesce(own["s"], F.lit(0.0))
        return F.coalesce((s + w * F.lit(self.mean)) / (n + w), F.lit(self.mean))


def fit_target_order(df: DataFrame, column: str, label: str) -> TargetOrder:
    """Counts and target sums per value and fold, with partial sums per task; the table is
    checkpointed, so scoring reads fixed data, and no value passes through the driver."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    y = quoted(label).cast("double")
    rows = df.where(y.isNotNull()).select(_present(column, df.schema[column].dataType).cast("string").alias("value"), y.alias("y"), row_fold(df).alias("fold"))
    # one shuffle: a value's folds are columns of fixed width until they become its map
    of_fold = [x for i in range(ORDER_FOLDS) for x in (F.count(F.when(F.col("fold") == i, 1)).alias(f"n{i}"), F.sum(F.when(F.col("fold") == i, F.col("y"))).alias(f"s{i}"))]
    by_value = rows.where("value IS NOT NULL").groupBy("value").agg(*of_fold)
    entries = F.array(*[F.struct(F.lit(i).alias("fold"), F.struct(F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s")).alias("of")) for i in range(ORDER_FOLDS)])
    n, s = sum(F.col(f"n{i}") for i in range(ORDER_FOLDS)), sum(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(ORDER_FOLDS))
    table = by_value.select("value", n.alias("n"), s.alias("s"), F.map_from_entries(F.filter(entries, lambda e: e["of"]["n"] > 0)).alias("folds")).checkpoint(eager=True)
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 32 * ORDER_FOLDS).alias("b")).first()
    return TargetOrder(table, float(rows.agg(F.avg("y")).first()[0] or 0.0), int(size["n"]), int(size["b"] or 0))


def row_fold(df: DataFrame) -> Column:
    # without the unit, which stands beside the columns that an order was fitted on
    hashable = [quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.name != UNIT]
    return F.pmod(F.xxhash64(*hashable), F.lit(ORDER_FOLDS)).cast("int")


def bin_of(v: Column, cuts: Sequence[float]) -> Column:
    """How many of the sorted cuts are below ``v``, by bisection."""
    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(float(lo))
        mid = (lo + hi) // 2
        return F.when(v <= F.lit(float(cuts[mid])), among(lo, mid)).otherwise(among(mid + 1, hi))
    return among(0, len(cuts))


# Rank error of a cut, as one in so many of all rows.
CUT_ACCURACY = 2_000


def fit_cuts(rows: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Where Spark's trees may split numeric columns: between all values, where those are at most
    ``bins``, else at ``bins`` equal shares of the rows (all of them; Spark ML looks at 10,000)."""
    if not columns:
        return {}
    shares = [i / bins for i in range(1, bins)]
    seen = rows.agg(*[F.approx_count_distinct(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)], *[F.max(quoted(c)).alias(f"m{i}") for i, c in enumerate(columns)],
                    *[F.percentile_approx(quoted(c), shares, CUT_ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    few = [i for i, _ in enumerate(columns) if seen[f"n{i}"] <= 2 * bins]
    values = rows.agg(*[F.sort_array(F.collect_set(quoted(columns[i]))).alias(f"v{i}") for i in few]).first() if few else {}
    cuts = {}
    for i, c in enumerate(columns):
        if i in few and len(values[f"v{i}"]) <= bins:
            v = values[f"v{i}"]
            cuts[c] = [(a + b) / 2 for a, b in zip(v, v[1:])]
        else:
            cuts[c] = sorted({q for q in seen[f"q{i}"] or [] if q < seen[f"m{i}"]})
    return cuts


@dataclass
class TreeFeatures:
    """D18 state: Spark trees do not take NULLs, so numeric features are
    filled with their (exact) training median and get a ``<c>__missing``
    indicator when the training data had NULLs; categorical features are
    label-encoded with NULL / unseen as an extra last code.  Columns of over 100 values
    are encoded through a dictionary table, and those of over ``NOMINAL_CATEGORIES`` are
    numbers in the order of the target (``TargetOrder``), which need no bin per value."""
    features: list[str]
    categories: dict[str, list] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    indicators: list[str] = field(default_factory=list)
    wide: LabelEncoderModel = field(default_factory=lambda: LabelEncoderModel())
    ordered: dict[str, TargetOrder] = field(default_factory=dict)
    cuts: dict[str, list[float]] = field(default_factory=dict)  # numbers that travel as their bin: how many cuts are below

    def columns(self) -> list[str]:
        return list(self.features) + [f"{c}__missing" for c in self.indicators]

    def transform(self, df: DataFrame, keep: Sequence[str] = (), label: str | None = None) -> DataFrame:
        """``label`` marks ``df`` as the training rows, as they were fitted: target orders then leave out each row's own fold."""
        types = {f.name: f.dataType for f in df.schema.fields}
        base, private = df.withColumn("__fold", row_fold(df)) if label and self.ordered else df, {}
        for i, (c, order) in enumerate(self.ordered.items()):
            base = order._joined(base, _present(c, types[c]).cast("string"), i)
            private[c] = order.number(i, F.col("__fold") if label else None)
        if self.wide.dictionaries:
            # the codes stand beside the columns under a suffix
            base = self.wide.transform(base, suffix="__code")
            private |= {c: F.coalesce(quoted(f"{c}__code").cast("double"), F.lit(float(self.wide.dictionary_rows[c]))) for c in self.wide.dictionaries}
        exprs = []
        for c in self.features:
            col = quoted(c)
            if c in self.ordered:
                exprs.append(private[c].alias(c))
            elif c in self.categories or c in self.wide.dictionaries:
                if c in self.categories:
                    cats = self.categories[c]
                    m = F.create_map(*[x for i, v in enumerate(cats) for x in (F.lit(v), F.lit(float(i)))]) if cats else None
                    code = F.coalesce(F.element_at(m, category_key(c, types[c])), F.lit(float(len(cats)))) if cats else F.lit(0.0)
                    n = len(cats)
                else:
                    code, n = private[c], self.wide.dictionary_rows[c]
                exprs.append(code.alias(c, metadata={"ml_attr": {"type": "nominal", "name": c, "num_vals": n + 1}}))
            else:
                v = col.cast("double")
                v = F.when(~F.isnan(v), v)
                exprs.append(F.coalesce(v, F.lit(self.medians.get(c, 0.0))).alias(c))
        for c in self.indicators:
            exprs.append(quoted(c).isNull().cast("double").alias(f"{c}__missing"))
        # a kept column that is also a feature appears once, as the feature
        passthrough = [k for k in keep if k not in self.columns()]
        out = base.select(*map(quoted, passthrough), *exprs)
        return out.withColumns({c: bin_of(quoted(c), cuts) for c, cuts in self.cuts.items()}) if self.cuts else out

    def save(self, path: str, spark) -> None:
        """One JSON line and the dictionary tables, so that a saved model can be scored elsewhere with the training categories and medians."""
        ordered = {c: {"at": f"order{i}", "mean": o.mean, "rows": o.rows, "nbytes": o.nbytes} for i, (c, o) in enumerate(self.ordered.items())}
        text = json.dumps({"features": self.features, "categories": self.categories, "medians": self.medians, "indicators": self.indicators,
                           "wide": bool(self.wide.dictionaries), "ordered": ordered, "cuts": self.cuts}, default=str)
        spark.createDataFrame([(text,)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")
        if self.wide.dictionaries:
            self.wide.save(f"{path}/wide")
        for i, o in enumerate(self.ordered.values()):
            o.table.write.mode("overwrite").parquet(f"{path}/order{i}")

    @staticmethod
    def load(spark, path: str) -> "TreeFeatures":
        state = json.loads(spark.read.text(f"{path}/state").collect()[0][0])
        wide = LabelEncoderModel.load(spark, f"{path}/wide") if state.pop("wide") else LabelEncoderModel()
        ordered = {c: TargetOrder(spark.read.parquet(f"{path}/{o['at']}"), o["mean"], o["rows"], o["nbytes"]) for c, o in state.pop("ordered").items()}
        return TreeFeatures(**state, wide=wide, ordered=ordered)

    def max_bins(self) -> int:
        return max([32] + [len(v) + 1 for v in self.categories.values()] + [n + 1 for n in self.wide.dictionary_rows.values()])


def fit_tree_features(df: DataFrame, features: Sequence[str], categoricals: Sequence[str] = (), max_categories: int = 10_000, label: str | None = None,
                      nominal: int | None = None) -> TreeFeatures:
    """``label`` lets columns of over ``nominal`` (NOMINAL_CATEGORIES) values be ordered by it; without one they
    keep a code and a bin per value, up to ``max_categories`` values."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cats = [c for c in features if c in categoricals or isinstance(types[c], (T.StringType, T.BooleanType))]
    nums = [c for c in features if c not in cats]
    limit = NOMINAL_CATEGORIES if nominal is None else nominal
    # no dictionary is made for a column that is far over the limit: an order has no use for one
    far = df.agg(*[F.approx_count_distinct(_present(c, types[c]).cast("string")).alias(f"n{i}") for i, c in enumerate(cats)]).first() if label is not None and cats else []
    over = [c for c, n in zip(cats, far) if n > 2 * limit + 100]
    encoder = fit_label_encoder(df, [c for c in cats if c not in over])
    size = {c: encoder.dictionary_rows.get(c, len(encoder.categories.get(c, []))) for c in cats}
    ordered = [c for c in cats if c in over or label is not None and size[c] > limit]
    too_many = [c for c in cats if c not in ordered and size[c] > max_categories]
    if too_many:
        raise ValueError(f"more than {max_categories} categories in {too_many}: give the label to order them by")
    wide = [c for c in encoder.dictionaries if c not in ordered]
    state = TreeFeatures(list(features), {c: v for c, v in encoder.categories.items() if c not in ordered})
    state.wide = LabelEncoderModel({}, None, {c: encoder.dictionaries[c] for c in wide}, {c: encoder.dictionary_rows[c] for c in wide}, {c: encoder.dictionary_bytes[c] for c in wide})
    state.ordered = {c: fit_target_order(df, c, label) for c in ordered}
    if nums:
        nulls = df.agg(*[(F.count(F.lit(1)) - F.count(F.when(~F.isnan(quoted(c).cast("double")),
                                                             quoted(c)))).alias(f"n{i}")
                         for i, c in enumerate(nums)]).collect()[0]
        with_nulls = [c for i, c in enumerate(nums) if nulls[f"n{i}"] > 0]
        state.indicators = with_nulls
        if with_nulls:
            med = column_quantiles(df, {c: quoted(c) for c in with_nulls}, [0.5])
            state.medians = {c: (r["q"][0] if r["q"][0] is not None else 0.0) for c, r in med.items()}
    return state


# Classes of a one-vs-rest model that are fitted at once; each holds its own binned rows.
CLASSES_AT_ONCE = 3


def gbt_estimator(label: str, task: str, params: Mapping | None, max_bins: int, n_classes: int | None = None, weight: str | None = None):
    """The boosted estimator of a task; more than two classes become one-vs-rest.

    With spark.checkpoint.dir set, the boosting state is checkpointed every
    25 trees, so long fits keep a short lineage and survive lost executors."""
    weights = {"weightCol": weight} if weight else {}
    common = dict(featuresCol=FEATURES, labelCol=label, maxBins=max_bins, checkpointInterval=25, **gbt_params(params), **weights)
    if task == "regression":
        return GBTRegressor(**common)
    clf = GBTClassifier(**common)
    if (n_classes or 2) <= 2:
        return clf
    # the fits are independent, and small jobs of one leave cores idle for the others
    return OneVsRest(classifier=clf, featuresCol=FEATURES, labelCol=label, parallelism=min(n_classes, CLASSES_AT_ONCE), **weights)


def fit_gbt(df: DataFrame, features: Sequence[str], label: str, task: str = "regression",
            params: Mapping | None = None, categoricals: Sequence[str] = (),
            n_classes: int | None = None, max_categories: int = 10_000):
    """M3: returns (model, TreeFeatures).  ``task`` is 'regression' or
    'classification'; labels must be 0..k-1 for classification."""
    state = fit_tree_features(df, features, categoricals, max_categories, label=label)
    data, weight, n_rows = None, None, df.count()
    if not state.ordered:
        rows = state.transform(df.withColumn(UNIT, row_unit(df)), keep=[label, UNIT])
        data = grouped_rows(assemble(rows, state.columns()).select(FEATURES, label, UNIT), label, task)
    numbers = [c for c in state.features if c not in state.categories and c not in state.wide.dictionaries]
    if data is None and n_rows > BIN_ROWS and numbers:
        rows = state.transform(df.withColumn(UNIT, row_unit(df)), keep=[label, UNIT], label=label)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            cuts = fit_cuts(rows, numbers, state.max_bins())
            binned = rows.withColumns({c: bin_of(quoted(c), x) for c, x in cuts.items()})
            data = grouped_rows(assemble(binned, state.columns()).select(FEATURES, label, UNIT), label, task)
            if data is not None:
                weight, state.cuts, data = WEIGHT, cuts, data.persist(StorageLevel.MEMORY_AND_DISK)
                groups = data.count()  # while the rows are there
        finally:
            rows.unpersist()
    if weight:
        # a tree level is a job over them: few rows a task would only add tasks to each
        fitted = data.coalesce(max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-groups // GROUPS_PER_TASK))))
    elif data is not None:
        weight, fitted = WEIGHT, spread(data, n_rows // GROUP_GAIN).persist(StorageLevel.MEMORY_AND_DISK)
        data = fitted
    else:
        fitted = data = training_set(state.transform(df, keep=[label], label=label), state.columns(), label, n_rows=n_rows)
    try:
        if task != "regression" and n_classes is None:
            n_classes = int(data.agg(F.max(label)).collect()[0][0]) + 1
        return gbt_estimator(label, task, params, state.max_bins(), n_classes, weight).fit(fitted), state
    finally:
        data.unpersist()


def predict(model: Model, df: DataFrame, features: Sequence[str], target: str | None,
            keep: Sequence[str] | None = None, tree_state: TreeFeatures | None = None, handle_invalid: str = "error") -> DataFrame:
    """Score every row and append ``predicted_<target>``.  A missing
    feature fails the job (D17) unless ``handle_invalid`` says 'skip' or 'keep'."""
    keep = list(keep) if keep is not None else list(df.columns)
    # kept columns travel under private names, so they may overlap features
    tagged = df.select("*", *[F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep)])
    tags = [f"__keep{i}" for i in range(len(keep))]
    base = tree_state.transform(tagged, keep=tags) if tree_state is not None else tagged
    cols = tree_state.columns() if tree_state is not None else list(features)
    scored = model.transform(assemble(base, cols, handle_invalid=handle_invalid))
    name = f"predicted_{target}" if target else "prediction"
    return scored.select(*[F.col(t).alias(c) for t, c in zip(tags, keep)], F.col("prediction").alias(name))


def save_bundle(path: str, model: Model, meta: Mapping) -> None:
    """Spark ML model folder plus a JSON sidecar with feature state."""
    model.write().overwrite().save(os.path.join(path, "model"))
    spark = __import__("pyspark.sql", fromlist=["SparkSession"]).SparkSession.getActiveSession()
    text = json.dumps(dict(meta), default=str)
    spark.createDataFrame([(text,)], "meta string").coalesce(1).write.mode("overwrite").text(
        os.path.join(path, "meta"))


def load_bundle(path: str, model_cls) -> tuple[Model, dict]:
    spark = __import__("pyspark.sql", fromlist=["SparkSession"]).SparkSession.getActiveSession()
    model = model_cls.load(os.path.join(path, "model"))
    text = spark.read.text(os.path.join(path, "meta")).collect()[0][0]
    return model, json.loads(text)


def coefficient_table(model, names: Sequence[str]) -> DataFrame:
    """Coefficients of a linear / binary logistic model as (feature, coefficient)."""
    spark = SparkSession.getActiveSession()
    n_classes = getattr(model, "numClasses", 2)
    if n_classes > 2:
        # multinomial: one coefficient row per class and feature
        mat = model.coefficientMatrix.toArray()
        icp = model.interceptVector.toArray()
        rows = [(f"{n}[class={k}]", float(mat[k, j])) for k in range(mat.shape[0]) for j, n in enumerate(names)]
        rows += [(f"(intercept)[class={k}]", float(icp[k])) for k in range(len(icp))]
    else:
        coefs = model.coefficients.toArray().tolist()
        rows = [(n, float(c)) for n, c in zip(names, coefs)] + [("(intercept)", float(model.intercept))]
    return spark.createDataFrame(rows, "feature string, coefficient double")



def score_and_export(model: Model, df: DataFrame, features: Sequence[str], target: str | None, path: str,
                     fmt: str = "csv", tree_state: TreeFeatures | None = None) -> None:
    """M7: score every row (M6) and write the result folder (S7) from the
    executors; nothing passes through the driver."""
    from ..sources.files import write_table
    write_table(predict(model, df, features, target, tree_state=tree_state), path, fmt=fmt)
