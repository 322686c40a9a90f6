"""Feature preparation as stages of a Spark ML pipeline.

``LinearFeatureStage`` and ``TreeFeatureStage`` are estimators over a raw table; their
models hold the fitted state of ``fit_linear_features`` / ``fit_tree_features`` and append
the assembled vector ``features``.  Both can be written, so a ``PipelineModel`` of
preparation and learner is one saved folder that scores raw tables, unseen categories and
missing values included, in a session that knows nothing else of the fit.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import quoted
from .features import LinearFeaturesModel, fit_linear_features
from .models import FEATURES, TreeFeatures, assemble, fit_tree_features, gbt_estimator


class _LinearState:
    """The state of linear features, saved like the others."""

    @staticmethod
    def save(state: LinearFeaturesModel, path: str, spark: SparkSession) -> None:
        spark.createDataFrame([(state.to_json(),)], "state string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearFeaturesModel:
        return LinearFeaturesModel.from_json(spark.read.text(path).collect()[0][0])


class _TreeState:
    @staticmethod
    def save(state: TreeFeatures, path: str, spark: SparkSession) -> None:
        state.save(path, spark)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeFeatures:
        return TreeFeatures.load(spark, path)


KINDS = {"linear": _LinearState, "tree": _TreeState}


class PreparedFeatures(Model, MLWritable, MLReadable):
    """Appends the prepared features of every row as one vector column; all columns stay as they are."""

    def __init__(self, kind: str, state, handle_invalid: str = "error"):
        super().__init__()
        self.kind, self.state, self.handle_invalid = kind, state, handle_invalid

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept = [f"__raw{i}" for i in range(len(dataset.columns))]
        tagged = dataset.select("*", *[quoted(c).alias(k) for c, k in zip(dataset.columns, kept)])
        prepared = self.state.transform(tagged, keep=kept)
        columns = self.state.train_columns if self.kind == "linear" else self.state.columns()
        # vectors are assembled from columns of private names: a raw column may be called like a feature
        named = prepared.select(*kept, *[quoted(c).alias(f"__x{i}", metadata=prepared.schema[c].metadata) for i, c in enumerate(columns)])
        out = assemble(named, [f"__x{i}" for i in range(len(columns))], handle_invalid=self.handle_invalid)
        return out.select(*[F.col(k).alias(c) for c, k in zip(dataset.columns, kept)], FEATURES)

    def write(self) -> "_Writer":
        return _Writer(self)

    @classmethod
    def read(cls) -> "_Reader":
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: PreparedFeatures):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        extra = {"kind": self.instance.kind, "handle_invalid": self.instance.handle_invalid}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=extra)
        KINDS[self.instance.kind].save(self.instance.state, f"{path}/state", self.sparkSession)


class _Reader(MLReader):
    def load(self, path: str) -> PreparedFeatures:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = PreparedFeatures(meta["kind"], KINDS[meta["kind"]].load(self.sparkSession, f"{path}/state"), meta["handle_invalid"])
        stage._resetUid(meta["uid"])
        return stage


class LinearFeatureStage(Estimator):
    """Dummies and standardised columns of ``features``."""

    def __init__(self, features: Sequence[str], numeric_categoricals: Sequence[str] = (), handle_invalid: str = "error"):
        super().__init__()
        self.features, self.numeric_categoricals, self.handle_invalid = list(features), list(numeric_categoricals), handle_invalid

    def _fit(self, dataset: DataFrame) -> PreparedFeatures:
        return PreparedFeatures("linear", fit_linear_features(dataset, self.features, self.numeric_categoricals), self.handle_invalid)


class TreeFeatureStage(Estimator):
    """Codes, medians and missing indicators of ``features``."""

    def __init__(self, features: Sequence[str], categoricals: Sequence[str] = ()):
        super().__init__()
        self.features, self.categoricals = list(features), list(categoricals)

    def _fit(self, dataset: DataFrame) -> PreparedFeatures:
        return PreparedFeatures("tree", fit_tree_features(dataset, self.features, self.categoricals))


def linear_pipeline(features: Sequence[str], label: str, task: str = "regression", numeric_categoricals: Sequence[str] = (), reg: float = 0.0) -> Pipeline:
    """Preparation and a linear or logistic model, over raw tables."""
    learner = (LinearRegression(featuresCol=FEATURES, labelCol=label, regParam=reg, standardization=False) if task == "regression"
               else LogisticRegression(featuresCol=FEATURES, labelCol=label, regParam=reg, standardization=False))
    return Pipeline(stages=[LinearFeatureStage(features, numeric_categoricals), learner])


def gbt_pipeline(df: DataFrame, features: Sequence[str], label: str, task: str = "regression", params=None, categoricals: Sequence[str] = (), n_classes: int | None = None) -> PipelineModel:
    """A boosted model fitted over a raw table, preparation included."""
    prepared = TreeFeatureStage(features, categoricals).fit(df)
    data = prepared.transform(df).select(FEATURES, label).hint("rebalance", df.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        return PipelineModel([prepared, gbt_estimator(label, task, params, prepared.state.max_bins(), n_classes).fit(data)])
    finally:
        data.unpersist()


def save_pipeline(model: PipelineModel, path: str, meta: dict | None = None) -> None:
    """One folder, with the caller's notes beside the stages."""
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta or {}, default=str),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/notes")


def load_pipeline(path: str) -> tuple[PipelineModel, dict]:
    spark = SparkSession.getActiveSession()
    return PipelineModel.load(path), json.loads(spark.read.text(f"{path}/notes").collect()[0][0])
