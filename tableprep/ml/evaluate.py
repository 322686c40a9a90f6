"""Metrics, cross-validation and hyperparameter search (M4, M5, M8, M9)."""

from __future__ import annotations

import math
import threading
import uuid
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import assign_folds
from ..functions.names import quoted
from .cells import FoldCells, fold_cells
from .models import FEATURES, UNIT, WEIGHT, assemble, fit_tree_features, gbt_estimator, grouped_rows, row_unit, spread, training_set


def r2_score(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """M8: 1 - SSE / SST in one aggregate pass (SST from the moments:
    sum(y^2) - n * mean^2 is replaced by n * var_pop for stability)."""
    y, p = quoted(label).cast("double"), quoted(prediction).cast("double")
    # both sums are over the rows that have a label and a prediction
    both = df.where(y.isNotNull() & p.isNotNull())
    agg = both.agg(F.sum((y - p) * (y - p)).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"))
    return agg.select(F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r2"))


def accuracy_score(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """M9: share of rows whose prediction equals the label."""
    return df.agg(F.avg((quoted(label).cast("double") == quoted(prediction).cast("double")).cast("double"))
                  .alias("accuracy"))


def _evaluator(task: str, label: str):
    if task == "regression":
        return RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="r2")
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy")


def _default_estimator(task: str, label: str):
    if task == "regression":
        return LinearRegression(featuresCol=FEATURES, labelCol=label)
    return LogisticRegression(featuresCol=FEATURES, labelCol=label)


def _fold_score(data: DataFrame | FoldCells, estimator, evaluator, fold: int, train: DataFrame | None = None) -> float:
    """Score on one fold of an estimator fitted on the others (on those of ``train``, if given)."""
    if isinstance(data, FoldCells):
        return data.score(estimator, fold)
    return evaluator.evaluate(estimator.fit((train or data).where(F.col("fold") != fold)).transform(data.where(F.col("fold") == fold)))


def _fold_scores(data: DataFrame, estimator, evaluator, k: int, train: DataFrame | None = None) -> list[float]:
    """Score on each fold; no fit beyond the k needed."""
    return [_fold_score(data, estimator, evaluator, i, train) for i in range(k)]


def cv_scores(df: DataFrame, features: Sequence[str], label: str, key_cols: Sequence[str],
              estimator=None, task: str = "regression", k: int = 5, seed: int = 42) -> DataFrame:
    """M4: shuffled K-fold CV; folds are ``hash(key) % k`` so they do not
    depend on partitioning.  Returns mean and std (sample) of R^2 or accuracy.
    Without an estimator: OLS, or logistic regression for classification."""
    data = assign_folds(assemble(df, features), key_cols, k, seed).select(FEATURES, label, "fold").persist()
    try:
        scores = _fold_scores(data, estimator or _default_estimator(task, label), _evaluator(task, label), k)
    finally:
        data.unpersist()
    return _score_row(df, scores)


def _score_row(df: DataFrame, scores: list[float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(float(np.mean(scores)), float(np.std(scores, ddof=1)), len(scores))],
                                           "cv_mean double, cv_std double, folds int")


# Bytes of a partition of the persisted fold set: a learner starts a task per partition and tree level.
FOLD_PART_BYTES = 32 << 20


def _gbt_folds(df: DataFrame, features: Sequence[str], label: str, key_cols: Sequence[str], task: str, categoricals: Sequence[str], k: int, seed: int,
               part_bytes: int = FOLD_PART_BYTES, units: bool = False):
    """Persisted (features, label, fold) rows of a boosted model, in partitions of a measured size, its bin count and class count; ``units`` adds each row's unit."""
    # without the label: an order of categories by the target would have seen the folds that are scored
    state = fit_tree_features(df, features, categoricals)
    folded, kept = assign_folds(df, key_cols, k, seed), [label, "fold"]
    if units:
        folded, kept = folded.withColumn(UNIT, row_unit(df)), [*kept, UNIT]
    rows = state.transform(folded, keep=kept)
    found = rows.agg(F.count(F.lit(1)), *([] if task == "regression" else [F.max(quoted(label))])).first()
    parts = max(1, -(-int(found[0]) * 8 * (len(state.columns()) + 4) // part_bytes))
    data = assemble(rows, state.columns()).select(FEATURES, *map(quoted, kept))
    data = (data.coalesce(1) if parts == 1 else data.repartition(parts)).persist()
    return data, state.max_bins(), None if task == "regression" else int(found[1]) + 1


def cv_gbt_scores(df: DataFrame, features: Sequence[str], label: str, key_cols: Sequence[str], task: str = "regression", params: Mapping | None = None,
                  categoricals: Sequence[str] = (), k: int = 5, seed: int = 42, nominal: int | None = None) -> DataFrame:
    """M4 of the boosted model, categorical features of any width and any number of classes included.

    Categories that are ordered by the target (those of over ``nominal`` values) are ordered
    anew for every fold, by the rows of the others alone, so no score has seen its labels."""
    if fit_tree_features(df, features, categoricals, label=label, nominal=nominal).ordered:
        return _score_row(df, _ordered_fold_scores(df, features, label, key_cols, task, params, categoricals, k, seed, nominal))
    data, bins, classes = _gbt_folds(df, features, label, key_cols, task, categoricals, k, seed, units=True)
    # fits read rows of equal features and fold as one; the scores are those of the single rows
    train, estimator = grouped_rows(data, label, task, ["fold"]), gbt_estimator(label, task, params, bins, classes)
    if train is not None:
        train, estimator = spread(train).persist(), estimator.setWeightCol(WEIGHT)
    try:
        return _score_row(df, _fold_scores(data, estimator, _evaluator(task, label), k, train))
    finally:
        data.unpersist()
        if train is not None:
            train.unpersist()


def _ordered_fold_scores(df, features, label, key_cols, task, params, categoricals, k, seed, nominal) -> list[float]:
    folded, scores = assign_folds(df, key_cols, k, seed), []
    classes = None if task == "regression" else int(df.agg(F.max(quoted(label))).first()[0]) + 1
    for i in range(k):
        train, test = folded.where(F.col("fold") != i), folded.where(F.col("fold") == i)
        state = fit_tree_features(train, features, categoricals, label=label, nominal=nominal)
        data = training_set(state.transform(train, keep=[label], label=label), state.columns(), label, n_rows=train.count())
        try:
            model = gbt_estimator(label, task, params, state.max_bins(), classes).fit(data)
        finally:
            data.unpersist()
        scores.append(_evaluator(task, label).evaluate(model.transform(assemble(state.transform(test, keep=[label]), state.columns()))))
    return scores


# Search ranges of the reference's GBDT tuning form
# (name, low, high, integer?, log scale?).
SEARCH_SPACE = (
    ("n_estimators", 100, 1000, True, False),
    ("learning_rate", 0.01, 0.3, False, False),
    ("max_depth", 3, 10, True, False),
    ("num_leaves", 20, 300, True, False),
    ("subsample", 0.6, 1.0, False, False),
    ("colsample_bytree", 0.6, 1.0, False, False),
)


def draw_trials(n_trials: int, seed: int = 42, space=SEARCH_SPACE,
                overrides: Mapping | None = None) -> list[dict]:
    """Seeded random draws from the search space (uniform, or log-uniform)."""
    rng = np.random.default_rng(seed)
    trials = []
    for _ in range(n_trials):
        t = {}
        for name, lo, hi, is_int, log in space:
            if log:
                v = math.exp(rng.uniform(math.log(lo), math.log(hi)))
            else:
                v = rng.uniform(lo, hi + (1 if is_int else 0))
            t[name] = int(min(v, hi)) if is_int else float(v)
        t.update(overrides or {})
        trials.append(t)
    return trials


class _Search:
    """The folds scored so far, and what they prove.

    Taken one after another, a trial is given up after the first fold at which it could not
    reach the best mean of the trials before it even with perfect scores (1.0) on the rest.
    That rule alone says what is reported; fits that run beside it can only be cancelled
    when the rule is certain to give their trial up."""

    def __init__(self, n_trials: int, k: int):
        self.k, self.scores = k, [[None] * k for _ in range(n_trials)]

    def hopeless(self, trial: int, best: float | None) -> int | None:
        """The fold after which the trial is given up against ``best``, as far as the folds are known."""
        total = 0.0
        for done, score in enumerate(self.scores[trial][:-1], 1):
            if score is None:
                return None
            total += score
            if best is not None and (total + self.k - done) / self.k < best:
                return done
        return None

    def mean(self, trial: int) -> float | None:
        folds = self.scores[trial]
        return None if None in folds else float(np.mean(folds))

    def surely_hopeless(self, trial: int) -> bool:
        """Some earlier trial that the rule keeps already beats this one."""
        return any(self.mean(t) is not None and self.hopeless(trial, self.mean(t)) is not None for t in range(trial))

    def report(self) -> list[tuple[float | None, float | None, int]]:
        """Mean, deviation and folds of every trial, by the rule."""
        out, best = [], None
        for t, folds in enumerate(self.scores):
            stop = self.hopeless(t, best)
            if stop is not None:
                out.append((None, None, stop))
                continue
            mean = float(np.mean(folds))
            out.append((mean, float(np.std(folds, ddof=1)), self.k))
            best = mean if best is None else max(best, mean)
        return out


def search_folds(spark, n_trials: int, k: int, score: Callable[[int, int], float], parallelism: int, give_up: bool = True) -> list[tuple[float | None, float | None, int]]:
    """``score(trial, fold)`` of all folds that the search needs, ``parallelism`` at once, trial by trial.

    Each fit runs in a thread of its own under a job tag of its trial; when the trial is
    proved hopeless, its waiting folds are skipped and its running jobs cancelled.  Without
    ``give_up`` every fold of every trial is scored, however bad its first ones were."""
    found, tag, sc = _Search(n_trials, k), f"search-{uuid.uuid4().hex}", spark.sparkContext
    lock, jobs = threading.Lock(), iter([(t, f) for t in range(n_trials) for f in range(k)])
    given_up: set[int] = set()
    running: dict[int, int] = {}  # fits under way of each trial
    errors: list[BaseException] = []

    def work() -> None:
        while True:
            with lock:
                job = next(jobs, None)
                while job and job[0] in given_up:
                    job = next(jobs, None)
                if job is None or errors:
                    return
                trial, fold = job
                running[trial] = running.get(trial, 0) + 1
            sc.addJobTag(f"{tag}-{trial}")
            try:
                value = float(score(trial, fold))
            except BaseException as e:
                if trial not in given_up:
                    errors.append(e)
                    return
                continue
            finally:
                sc.removeJobTag(f"{tag}-{trial}")
                with lock:
                    running[trial] -= 1
            with lock:
                found.scores[trial][fold] = value
                if give_up:
                    given_up.update(t for t in range(trial, n_trials) if t not in given_up and found.surely_hopeless(t))

    threads = [InheritableThread(target=work) for _ in range(min(parallelism, n_trials * k))]
    for t in threads:
        t.start()
    for t in threads:
        while t.is_alive():
            t.join(0.2)
            # a fit is many jobs: what it starts after a cancelling goes as well
            for trial in [i for i in list(given_up) if running.get(i)]:
                sc.cancelJobsWithTag(f"{tag}-{trial}")
    if errors:
        raise errors[0]
    return found.report() if give_up else [(float(np.mean(folds)), float(np.std(folds, ddof=1)), k) for folds in found.scores]


def random_search(df: DataFrame, features: Sequence[str], label: str, key_cols: Sequence[str],
                  task: str = "regression", n_trials: int = 20, k: int = 5, seed: int = 42,
                  overrides: Mapping | None = None, categoricals: Sequence[str] = (), parallelism: int | None = None) -> DataFrame:
    """M5: seeded random search over the GBDT space, each trial scored by
    K-fold CV on the same hash folds; one row per trial, best first.

    The fits are independent and run ``parallelism`` at once (default: one per core that the
    session has) over one persisted fold set, whose partitions follow its size.  Every trial
    is scored on all ``k`` folds; none is given up early.  Two classes of numeric features are
    counted into cells first, and a fit is then one task (``cells``).

    ``overrides`` pins parameters (e.g. a smaller ``n_estimators`` budget)."""
    spark = df.sparkSession
    trials = draw_trials(n_trials, seed, overrides=overrides)
    data, bins, classes = _gbt_folds(df, features, label, key_cols, task, categoricals, k, seed)
    evaluator = _evaluator(task, label)

    def score(trial: int, fold: int) -> float:
        params = {n: v for n, v in trials[trial].items() if n != "num_leaves"}
        return _fold_score(cells or data, gbt_estimator(label, task, params, bins, classes), evaluator, fold)

    try:
        data.count()
        cells = fold_cells(data, FEATURES, label, k, bins) if classes and classes <= 2 else None
        found = search_folds(spark, n_trials, k, score, parallelism or spark.sparkContext.defaultParallelism, give_up=False)
    finally:
        data.unpersist()
    rows = [(i, int(t["n_estimators"]), float(t["learning_rate"]), int(t["max_depth"]), float(t["subsample"]), float(t["colsample_bytree"]), *found[i])
            for i, t in enumerate(trials)]
    out = spark.createDataFrame(rows, "trial int, n_estimators int, learning_rate double, max_depth int, "
                                      "subsample double, colsample_bytree double, cv_mean double, cv_std double, folds int")
    return out.orderBy(F.col("cv_mean").desc_nulls_last(), "trial")
