"""Linear features of any number of categories (L5, L8) as one sparse vector per row.

``OneHotModel`` makes one column per category, which bounds it.  Here a categorical column
is joined to its dictionary (value -> code) and becomes one non-zero entry of a sparse
vector, so neither the plan nor a row grows with the number of categories:

* layout: numeric columns first, then every categorical column's dummies in the order of
  their sorted values, the first dropped (the pandas ``get_dummies`` layout);
* standardisation: a dummy's mean and deviation follow from its category's count, so they
  come from one count per category instead of a pass per column.  Vectors are scaled but
  not centred, which would fill them; the centring is folded into the intercept
  (``LinearModel.intercept`` is the one of centred columns);
* NULL and unseen values have no entry: all zeros, as with dummy columns.

The dictionaries hold every value's code and rows, so names, means and deviations are a
table (``entries``) that no driver gathers.  Least squares with a wide column does not
gather its coefficients either: the column is absorbed (every row is taken against the mean
of its category), the rest is fitted by normal equations, and the dummies' coefficients are
what the category means leave over, one row per category.  Only ``moments``, the vectors of
``transform`` and the models that need them (logistic ones, and least squares with several
wide columns) hold numbers by the vector's length in the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from .features import LabelEncoderModel, ScalerModel, _present, fit_label_encoder, fit_scaler
from .models import FEATURES

NORMAL_SIZE = 200  # widest vector that is fitted by its normal equations, an absorbed column aside


@dataclass
class SparseFeatures:
    """Fitted state: dictionaries with the rows of every category, and the scaler of numeric columns."""
    features: list[str]
    numeric: list[str]
    categorical: list[str]
    encoder: LabelEncoderModel  # of a counted fit
    sizes: dict[str, int]  # categories of each categorical column
    n_rows: int
    scaler: ScalerModel

    def widths(self) -> list[int]:
        """Vector entries of each categorical column (its first category has none)."""
        return [max(self.sizes[c] - 1, 0) for c in self.categorical]

    def size(self) -> int:
        return len(self.numeric) + sum(self.widths())

    def _codes(self, spark, c: str) -> DataFrame:
        """(value, code, n): every category of a column, its code and its rows."""
        if c in self.encoder.dictionaries:
            return self.encoder.dictionaries[c].select("value", F.col("code").cast("long").alias("code"), "n")
        rows = zip(self.encoder.categories.get(c, []), self.encoder.counts.get(c, []))
        return spark.createDataFrame([(str(v), i, n) for i, (v, n) in enumerate(rows)], "value string, code long, n long")

    @cached_property
    def counts(self) -> dict[str, np.ndarray]:
        """Rows of each category, by code, in the driver."""
        out = {c: np.array(self.encoder.counts.get(c, []), np.int64) for c in self.categorical}
        for c, table in self.encoder.dictionaries.items():
            got = table.select(F.col("code").cast("long"), "n").toArrow()
            out[c] = np.zeros(self.sizes[c], np.int64)
            out[c][got.column(0).to_numpy()] = got.column(1).to_numpy()
        return out

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and population deviation (0 counts as 1) of every entry."""
        n = max(self.n_rows, 1)
        share = [self.counts[c][1:] / n for c in self.categorical]
        means = np.concatenate([[self.scaler.means[c] for c in self.numeric], *share]).astype(float)
        stds = np.concatenate([[self.scaler.stds[c] for c in self.numeric], *(np.sqrt(s * (1 - s)) for s in share)]).astype(float)
        return means, np.where(stds > 0, stds, 1.0)

    def entries(self, spark) -> DataFrame:
        """(feature, entry, mean, deviation): ``names`` and ``moments`` as a table; nothing but the numeric columns' passes through the driver."""
        rows = [(c, i, self.scaler.means[c], self.scaler.stds[c]) for i, c in enumerate(self.numeric)]
        out, first = spark.createDataFrame(rows, "feature string, entry long, mean double, deviation double"), len(self.numeric)
        share = F.col("n") / F.lit(float(max(self.n_rows, 1)))
        spread = F.sqrt(share * (1 - share))
        for c, width in zip(self.categorical, self.widths()):
            named = self._codes(spark, c).where("code > 0").select(
                F.concat(F.lit(f"{c}_"), "value").alias("feature"), (F.col("code") - 1 + first).alias("entry"), share.alias("mean"),
                F.when(spread > 0, spread).otherwise(1.0).alias("deviation"))
            out, first = out.unionByName(named), first + width
        return out

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns and the scaled sparse vector ``features``."""
        tagged = df.select(*[quoted(c).alias(f"__keep{i}") for i, c in enumerate(keep)], *[quoted(c) for c in self.features])
        coded = self.encoder.transform(tagged)
        exprs = [quoted(c).cast("double").alias(f"__num{i}") for i, c in enumerate(self.numeric)]
        used = [(i, c, self.sizes[c]) for i, c in enumerate(self.categorical) if self.sizes[c] > 1]
        for i, c, n in used:
            # the dropped entry of Spark's encoder is the last one: the first category, NULL and unseen values go there
            code = quoted(c).cast("long")
            place = F.when(code > 0, code - 1).otherwise(F.lit(n - 1)).cast("double")
            exprs.append(place.alias(f"__cat{i}", metadata={"ml_attr": {"type": "nominal", "name": f"__cat{i}", "num_vals": n}}))
        out = coded.select(*[F.col(f"__keep{i}") for i in range(len(keep))], *exprs)
        parts = [f"__num{i}" for i in range(len(self.numeric))]
        if used:
            ins, outs = [f"__cat{i}" for i, _, _ in used], [f"__hot{i}" for i, _, _ in used]
            # the sizes come from the metadata, so this fit reads no rows
            out = OneHotEncoder(inputCols=ins, outputCols=outs, dropLast=True, handleInvalid="error").fit(out).transform(out)
            parts += outs
        out = VectorAssembler(inputCols=parts, outputCol="__raw", handleInvalid="error").transform(out)
        scale = ElementwiseProduct(scalingVec=Vectors.dense(1.0 / self.moments()[1]), inputCol="__raw", outputCol="__scaled")
        out = scale.transform(out)
        return out.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], F.col("__scaled").alias(FEATURES))

    def names(self, spark) -> DataFrame:
        """(feature, entry): the dummy's or column's name of every vector entry."""
        return self.entries(spark).select("feature", "entry")

    def with_names(self, spark, **columns: np.ndarray) -> DataFrame:
        """A row per vector entry: its name, and the given numbers."""
        import pandas as pd
        values = spark.createDataFrame(pd.DataFrame({"entry": np.arange(self.size()), **columns}))
        return self.names(spark).join(values, "entry")


def fit_sparse_features(df: DataFrame, features: Sequence[str], numeric_categoricals: Sequence[str] = ()) -> SparseFeatures:
    """L8 fit without a bound on categories: text and boolean features and ``numeric_categoricals``
    become dictionary-coded dummies, everything is standardised."""
    types = {f.name: f.dataType for f in df.schema.fields}
    feats = list(features)
    cats = [c for c in feats if c in numeric_categoricals or isinstance(types[c], (T.StringType, T.BooleanType))]
    nums = [c for c in feats if c not in cats]
    encoder = fit_label_encoder(df, cats, counted=True)
    sizes = {c: encoder.dictionary_rows[c] if c in encoder.dictionaries else len(encoder.categories.get(c, [])) for c in cats}
    return SparseFeatures(feats, nums, cats, encoder, sizes, df.count(), fit_scaler(df, nums))


@dataclass
class LinearModel:
    """A linear or binary logistic model over ``SparseFeatures``, in terms of standardised columns."""
    state: SparseFeatures
    model: object
    coefficients: np.ndarray
    intercept: float

    def predict(self, df: DataFrame, keep: Sequence[str], name: str = "prediction") -> DataFrame:
        scored = self.model.transform(self.state.transform(df, keep))
        return scored.select(*map(quoted, keep), F.col("prediction").alias(name))

    def coefficient_table(self, spark) -> DataFrame:
        """(feature, coefficient) of every vector entry, and the intercept of centred columns."""
        rows = self.state.with_names(spark, coefficient=self.coefficients).select("feature", "coefficient")
        return rows.unionByName(spark.createDataFrame([("(intercept)", float(self.intercept))], "feature string, coefficient double"))


@dataclass
class AbsorbedModel:
    """Least squares with one wide column: ``rest`` fits the other columns, ``effects`` holds
    (value, code, n, effect) of every category of ``column``.  The effect of the first category
    stands for NULL and unseen values too, as they share its row of zeros."""
    state: SparseFeatures
    column: str
    others: SparseFeatures
    rest: np.ndarray  # coefficients of the other columns' scaled entries
    effects: DataFrame
    base: float

    def _first(self) -> int:
        """Entry of the wide column's first dummy."""
        return len(self.state.numeric) + sum(w for c, w in zip(self.state.categorical, self.state.widths()) if self.state.categorical.index(c) < self.state.categorical.index(self.column))

    def predict(self, df: DataFrame, keep: Sequence[str], name: str = "prediction") -> DataFrame:
        rows = _absorbing(self.others, df, self.column, keep)
        looked_up = rows.join(self.effects.select(F.col("value").alias("__value"), "effect"), "__value", "left")
        out = F.coalesce(F.col("effect"), F.lit(self.base))
        for i, w in enumerate(self.rest):
            out = out + F.lit(float(w)) * F.col("__z")[i]
        return looked_up.select(*[F.col(f"__kept{i}").alias(c) for i, c in enumerate(keep)], out.alias(name))

    @cached_property
    def intercept(self) -> float:
        """The intercept of centred columns: what is predicted at the mean of every column."""
        n = max(self.state.n_rows, 1)
        means, stds = self.others.moments()
        drawn = self.effects.agg(F.sum(F.col("n") * (F.col("effect") - F.lit(self.base)))).first()[0] or 0.0
        return float(self.base + drawn / n + self.rest @ (means / stds))

    def _entries(self, spark) -> DataFrame:
        """(feature, entry, coefficient) of every vector entry."""
        named = self.state.entries(spark)
        first, width = self._first(), self.state.sizes[self.column] - 1
        wide = self.effects.where("code > 0").select((F.col("code") - 1 + first).alias("entry"), (F.col("effect") - F.lit(self.base)).alias("gap"))
        mine = named.where(F.col("entry").between(first, first + width - 1)).join(wide, "entry")
        out = mine.select("feature", "entry", (F.col("gap") * F.col("deviation")).alias("coefficient"))
        narrow = [(i if i < first else i + width, float(w)) for i, w in enumerate(self.rest)]
        rest = spark.createDataFrame(narrow, "entry long, coefficient double")
        return out.unionByName(named.join(F.broadcast(rest), "entry").select("feature", "entry", "coefficient"))

    @cached_property
    def coefficients(self) -> np.ndarray:
        """Every entry's coefficient, in the driver."""
        from pyspark.sql import SparkSession
        got = self._entries(SparkSession.getActiveSession()).select("entry", "coefficient").toArrow()
        out = np.zeros(self.state.size())
        out[got.column(0).to_numpy()] = got.column(1).to_numpy()
        return out

    def coefficient_table(self, spark) -> DataFrame:
        rows = self._entries(spark).select("feature", "coefficient")
        return rows.unionByName(spark.createDataFrame([("(intercept)", self.intercept)], "feature string, coefficient double"))


def _absorbing(others: SparseFeatures, df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """``__kept<i>``, the wide column's text ``__value`` and the other columns' scaled entries ``__z``."""
    text = _present(column, df.schema[column].dataType).cast("string")
    tagged = df.select(*[quoted(c).alias(f"__kept{i}") for i, c in enumerate(keep)], text.alias("__value"), *map(quoted, others.features))
    tags = [*[f"__kept{i}" for i in range(len(keep))], "__value"]
    if not others.features:
        return tagged.select(*tags, F.array().cast("array<double>").alias("__z"))
    return others.transform(tagged, tags).select(*tags, vector_to_array(FEATURES).alias("__z"))


def _fit_absorbed(df: DataFrame, state: SparseFeatures, column: str, label: str) -> AbsorbedModel:
    """Least squares with ``column``'s dummies absorbed (Frisch-Waugh-Lovell): rows are taken against
    the means of their category, whose number only bounds the shuffled table of means."""
    feats = [c for c in state.features if c != column]
    cats = [c for c in state.categorical if c != column]
    e, codes = state.encoder, state.encoder.dictionaries[column]
    held = LabelEncoderModel({c: e.categories[c] for c in cats if c in e.categories}, None, *({c: d[c] for c in cats if c in d} for d in (e.dictionaries, e.dictionary_rows, e.dictionary_bytes, e.counts)))
    others = SparseFeatures(feats, state.numeric, cats, held, {c: state.sizes[c] for c in cats}, state.n_rows, state.scaler)
    width, first = others.size(), codes.where("code = 0").first()["value"]
    y = F.col("__kept0").cast("double")
    y = F.when(y.isNull() | F.isnan(y), F.raise_error(F.lit(f"labels must not be NULL or NaN: {label}")).cast("double")).otherwise(y)
    # NULL and the first category have no dummy: one group, the NULL one
    group = F.when(F.col("__value") != F.lit(first), F.col("__value"))
    rows = _absorbing(others, df, column, [label]).select(group.alias("__group"), y.alias("__y"), "__z")
    means = rows.groupBy("__group").agg(F.avg("__y").alias("__my"), *[F.avg(F.col("__z")[i]).alias(f"__m{i}") for i in range(width)]).checkpoint(eager=True)
    rest = np.zeros(width)
    if width:
        joined = rows.join(means.withColumnRenamed("__group", "__g"), F.expr("__group <=> __g"))
        gaps = joined.select((F.col("__y") - F.col("__my")).alias("__y"), *[(F.col("__z")[i] - F.col(f"__m{i}")).alias(f"__d{i}") for i in range(width)])
        data = VectorAssembler(inputCols=[f"__d{i}" for i in range(width)], outputCol=FEATURES).transform(gaps)
        rest = LinearRegression(featuresCol=FEATURES, labelCol="__y", regParam=0.0, standardization=False, fitIntercept=False, solver="normal").fit(data).coefficients.toArray()
    effect = F.col("__my")
    for i, w in enumerate(rest):
        effect = effect - F.lit(float(w)) * F.col(f"__m{i}")
    effects = means.select("__group", effect.alias("effect"))
    of_none = effects.where("__group IS NULL").first()
    base = float(of_none["effect"])
    table = codes.select("value", F.col("code").cast("long").alias("code"), "n").join(effects, F.col("value") == F.col("__group"), "left")
    return AbsorbedModel(state, column, others, rest, table.select("value", "code", "n", F.coalesce("effect", F.lit(base)).alias("effect")), base)


def fit_sparse_linear(df: DataFrame, features: Sequence[str], label: str, task: str = "regression", C: float = 1.0,
                      numeric_categoricals: Sequence[str] = (), max_iter: int = 500, tol: float = 1e-12) -> LinearModel | AbsorbedModel:
    """M1 / M2 over sparse dummies: the coefficients are those of centred, standardised columns."""
    state = fit_sparse_features(df, features, numeric_categoricals)
    widest = max(state.categorical, key=lambda c: state.sizes[c], default=None)
    if task == "regression" and state.size() > NORMAL_SIZE and widest in state.encoder.dictionaries and state.size() - state.sizes[widest] < NORMAL_SIZE:
        return _fit_absorbed(df, state, widest, label)
    data = state.transform(df, [label]).hint("rebalance", df.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        if task == "regression":
            # the normal equations of wide sparse data would be a dense square matrix
            solver = "normal" if state.size() <= NORMAL_SIZE else "l-bfgs"
            est = LinearRegression(featuresCol=FEATURES, labelCol=label, regParam=0.0, standardization=False, maxIter=max_iter, tol=tol, solver=solver)
        else:
            est = LogisticRegression(featuresCol=FEATURES, labelCol=label, regParam=1.0 / (C * max(state.n_rows, 1)), standardization=False, maxIter=max_iter, tol=tol, family="binomial")
        model = est.fit(data)
    finally:
        data.unpersist()
    coefs = model.coefficients.toArray()
    means, stds = state.moments()
    return LinearModel(state, model, coefs, float(model.intercept + coefs @ (means / stds)))
