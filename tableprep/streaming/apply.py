"""Apply fitted table-preparation state and models to streaming DataFrames.

The reference has no streams.  What carries over is everything that is a
per-row function once fitted: casts, zero fills, fills with already fitted
statistics, row filters, encoders, the scaler and model scoring.  Stages
that need the whole table (numbering, ordered fills, dedupe without a
watermark, sort, group-by, pivot, fitting statistics) are refused with an
error instead of being approximated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..ml import models
from ..operators import clean, reshape
from ..plans.prep import PrepPlan, apply_casts

_ROW_LOCAL_MISSING = ("", "drop", "zero")


def check_stream_safe(plan: PrepPlan, fitted: Mapping[str, object] | None = None) -> None:
    """Raise if ``plan`` has a stage that needs the whole table.  Mean /
    median / mode fills are allowed when their values are in ``fitted``."""
    fitted = fitted or {}
    problems = []
    if plan.index == "yes":
        problems.append("index numbering")
    for col, strategy in plan.missing:
        s = (strategy or "").strip()
        if s in ("forward", "backward"):
            problems.append(f"{s} fill of {col}")
        elif s in ("mean", "median", "mode") and col not in fitted:
            problems.append(f"{s} fill of {col} without a fitted value")
    if plan.dedupe:
        problems.append("dedupe (use dropDuplicatesWithinWatermark)")
    if plan.sort_column:
        problems.append("sort")
    if plan.group:
        problems.append("group-by (use a windowed aggregation with a watermark)")
    if plan.pivot:
        problems.append("pivot")
    if problems:
        raise ValueError("not applicable to a stream: " + ", ".join(problems))


def prep_stream(df: DataFrame, plan: PrepPlan, fitted: Mapping[str, object] | None = None) -> DataFrame:
    """The row-local stages of ``plan`` in the fixed order (remove first
    column -> missing -> casts -> filter), with statistic fills taken from
    ``fitted`` (column -> value fitted on a batch table)."""
    fitted = dict(fitted or {})
    check_stream_safe(plan, fitted)
    if plan.index == "remove":
        df = reshape.drop_first_column(df)
    for col, strategy in plan.missing:
        s = (strategy or "").strip()
        if s == "drop":
            df = clean.drop_missing(df, [col])
        elif s == "zero":
            df = clean.fill_zero(df, [col])
        elif s in ("mean", "median", "mode"):
            df = clean._fill_literals(df, {col: fitted[col]})
    if plan.casts:
        df = apply_casts(df, plan.casts, plan.on_fraction)
    if plan.filter:
        df = reshape.filter_rows(df, plan.filter, on_error=plan.on_error)
    return df


def score_stream(df: DataFrame, model, features: Sequence[str], target: str | None,
                 keep: Sequence[str] | None = None, tree_state: models.TreeFeatures | None = None,
                 feature_state=None) -> DataFrame:
    """M6 on a stream: fitted feature state (``LinearFeaturesModel`` or
    ``TreeFeatures``) and a fitted Spark ML model, row by row."""
    keep = list(keep) if keep is not None else [c for c in df.columns]
    if feature_state is not None:
        df = feature_state.transform(df, keep=keep)
        features = feature_state.columns() if isinstance(feature_state, models.TreeFeatures) else feature_state.train_columns
        return models.predict(model, df, features, target, keep=keep)
    return models.predict(model, df, features, target, keep=keep, tree_state=tree_state)

