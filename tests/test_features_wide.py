"""Sparse dummies, wide categories, pipeline stages, multinomial attribution."""

import datetime
import decimal

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tableprep.ml import evaluate, explain, features, models, sparse, stages
from tableprep.session import scratch_path


def table(spark, n=400):
    rows = [(i, float(i % 11), f"c{i % 7}" if i % 13 else None, i % 3 == 0, float((i * 37) % 101)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, c string, b boolean, y double")


def test_sparse_vectors_equal_dense_dummies(spark):
    df = table(spark)
    dense = features.fit_linear_features(df, ["x", "c", "b"])
    state = sparse.fit_sparse_features(df, ["x", "c", "b"])
    means, stds = state.moments()
    assert np.allclose(means, [dense.scaler.means[c] for c in dense.train_columns]) and np.allclose(stds, [dense.scaler.stds[c] for c in dense.train_columns])
    want = {r["id"]: [r[c] for c in dense.train_columns] for r in dense.transform(df, keep=["id"]).collect()}
    new = df.unionByName(spark.createDataFrame([(9000, 1.0, "never met", None, 0.0)], df.schema))
    got = {r["id"]: r["features"] for r in state.transform(new, keep=["id"]).collect()}
    for i, row in want.items():
        assert np.allclose(got[i].toArray() - means / stds, row)  # scaled, and centred here
    assert np.allclose(got[9000].toArray(), [1.0 / stds[0], *[0.0] * (state.size() - 1)])
    names = {r["entry"]: r["feature"] for r in state.names(spark).collect()}
    assert [names[i] for i in range(state.size())] == dense.train_columns


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_sparse_models_equal_dense_ones(spark, monkeypatch, task):
    df = table(spark).withColumn("y", F.col("y") + 9 * F.col("b").cast("int") if task == "regression" else (F.col("y") > 40).cast("double"))
    dense = features.fit_linear_features(df, ["x", "c", "b"])
    rows = dense.transform(df, keep=["id", "y"])
    plain = models.fit_ols(rows, dense.train_columns, "y") if task == "regression" else models.fit_logistic(rows, dense.train_columns, "y")
    for limit in (features.LITERAL_CATEGORIES, 2):  # literal maps, then dictionaries
        monkeypatch.setattr(features, "LITERAL_CATEGORIES", limit)
        model = sparse.fit_sparse_linear(df, ["x", "c", "b"], "y", task)
        assert np.allclose(model.coefficients, plain.coefficients.toArray(), atol=1e-5) and model.intercept == pytest.approx(plain.intercept, abs=1e-5)
        table_ = {r["feature"]: r["coefficient"] for r in model.coefficient_table(spark).collect()}
        assert len(table_) == model.state.size() + 1 and table_["(intercept)"] == pytest.approx(plain.intercept, abs=1e-5)
        a = {r["id"]: r["prediction"] for r in model.predict(df, ["id"]).collect()}
        b = {r["id"]: r["p"] for r in models.predict(plain, rows, dense.train_columns, None, keep=["id"]).withColumnRenamed("prediction", "p").collect()}
        assert all(a[i] == pytest.approx(b[i], abs=1e-4) for i in b)


def test_sparse_without_categories_or_with_one_value(spark):
    df = table(spark).withColumn("one", F.lit("same"))
    assert sparse.fit_sparse_features(df, ["x"]).size() == 1
    state = sparse.fit_sparse_features(df, ["one", "x"])
    assert state.size() == 1 and state.transform(df).first()["features"].toArray().shape == (1,)


def test_multinomial_attribution_against_probabilities(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(i, float(a), float(b), int(np.argmax([a, b, 0.3]))) for i, (a, b) in enumerate(x)], "id long, `f.1` double, g double, y int")
    plain = df.withColumnRenamed("f.1", "f1")
    m = models.fit_logistic(plain, ["f1", "g"], "y")
    p = {r["id"]: r["p"] for r in m.transform(models.assemble(plain, ["f1", "g"])).select("id", vector_to_array("probability").alias("p")).collect()}
    means = {"f.1": float(x[:, 0].mean()), "g": float(x[:, 1].mean())}
    out = explain.multinomial_attribution(df, m.coefficientMatrix.toArray(), m.interceptVector.toArray(), ["f.1", "g"], means, keep=["id"])
    got = {}
    for r in out.collect():
        assert r["base_value"] + r["f.1_contrib"] + r["g_contrib"] == pytest.approx(r["margin"], abs=1e-9)
        got.setdefault(r["id"], {})[r["class"]] = r["margin"]
    for i, margins in got.items():
        e = np.exp([margins[k] for k in range(3)])
        assert np.allclose(e / e.sum(), p[i]) and sum(margins.values()) == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("kind", ["linear", "logistic", "gbt"])
def test_saved_pipeline_scores_raw_tables(spark, kind):
    df = table(spark).withColumn("y", F.col("y") if kind != "logistic" else (F.col("y") > 50).cast("double"))
    if kind == "gbt":
        model = stages.gbt_pipeline(df, ["x", "c", "b"], "y", params={"n_estimators": 3, "max_depth": 3})
    else:
        model = stages.linear_pipeline(["x", "c", "b"], "y", "regression" if kind == "linear" else "classification", reg=0.1).fit(df)
    path = scratch_path(spark, "pipeline")
    stages.save_pipeline(model, path, {"target": "y"})
    again, notes = stages.load_pipeline(path)
    assert notes == {"target": "y"} and again.stages[0].uid == model.stages[0].uid
    raw = df.unionByName(spark.createDataFrame([(9000, 1.0, "never met", None, 0.0)], df.schema)).withColumn("train_columns", F.lit(1))
    a = sorted((r["id"], r["prediction"]) for r in model.transform(raw).collect())
    b = sorted((r["id"], r["prediction"]) for r in again.transform(raw).collect())
    assert a == b and len(a) == 401
    assert again.transform(raw).columns[: len(raw.columns)] == raw.columns


def test_wide_category_of_100_000_values(spark):
    rng = np.random.default_rng(1)
    effect = rng.normal(size=100_000)
    rows = spark.range(300_000).selectExpr("id", "concat('v', id % 100000) AS c", "CAST(id % 17 AS double) AS x")
    values = spark.createDataFrame([(f"v{i}", float(e)) for i, e in enumerate(effect)], "c string, y double")
    df = rows.join(values, "c")
    model, state = models.fit_gbt(df, ["c", "x"], "y", "regression", {"n_estimators": 10, "max_depth": 4, "learning_rate": 0.3})
    assert state.ordered["c"].rows == 100_000 and state.max_bins() == 32
    scored = models.predict(model, df.unionByName(spark.createDataFrame([("never met", -1, 1.0, 0.0), (None, -2, 1.0, 0.0)], df.schema)), ["c", "x"], "y", keep=["id", "y"], tree_state=state)
    assert scored.count() == 300_002 and scored.where("predicted_y IS NULL").count() == 0
    assert scored.where("id >= 0").stat.corr("y", "predicted_y") > 0.9


def test_target_orders_leave_their_own_fold_out(spark):
    """With a value of its own for every row, the label must not be in the training feature."""
    df = spark.range(2000).selectExpr("concat('k', id) AS k", "CAST(id % 7 AS double) AS y")
    state = models.fit_tree_features(df, ["k"], label="y", nominal=50)
    train = state.transform(df, keep=["y"], label="y")
    assert train.select(F.stddev_pop("k")).first()[0] == pytest.approx(0, abs=1e-9)
    assert state.transform(df, keep=["y"]).stat.corr("k", "y") > 0.99
    path = scratch_path(spark, "ordered")
    state.save(path, spark)
    again = models.TreeFeatures.load(spark, path)
    assert sorted(map(tuple, again.transform(df).collect())) == sorted(map(tuple, state.transform(df).collect()))
    with pytest.raises(ValueError, match="give the label"):
        models.fit_tree_features(df, ["k"], max_categories=100)


def test_cross_validation_of_wide_categories_sees_no_scored_label(spark):
    noise = spark.range(1500).selectExpr("id", "concat('k', id % 700) AS k", "CAST(xxhash64(id) % 1000 AS double) AS y")
    params = {"n_estimators": 8, "max_depth": 4, "learning_rate": 0.3}
    row = evaluate.cv_gbt_scores(noise, ["k"], "y", ["id"], params=params, k=3, nominal=100).first()
    assert row["cv_mean"] < 0.05 and row["folds"] == 3
    real = spark.range(2100).selectExpr("id", "concat('k', id % 300) AS k", "CAST((id % 300) * 7 % 300 AS double) AS y")
    assert evaluate.cv_gbt_scores(real, ["k"], "y", ["id"], params=params, k=3, nominal=100).first()["cv_mean"] > 0.7


def test_decimal_and_date_categories_of_boosted_trees(spark, monkeypatch):
    rows = [(decimal.Decimal(i % 5) / 2, datetime.date(2024, 1, 1 + i % 4), float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "d decimal(10,2), t date, y double")
    for limit in (features.LITERAL_CATEGORIES, 2):
        monkeypatch.setattr(features, "LITERAL_CATEGORIES", limit)
        model, state = models.fit_gbt(df, ["d", "t"], "y", "regression", {"n_estimators": 20, "max_depth": 4, "subsample": 1.0, "colsample_bytree": 1.0}, categoricals=["d", "t"])
        worst = models.predict(model, df, ["d", "t"], "y", keep=["y"], tree_state=state).selectExpr("max(abs(y - predicted_y))").first()[0]
        assert worst < 0.6


def test_leaf_budget_caps_the_depth():
    assert models.gbt_params({"num_leaves": 31, "max_depth": 10}, cap_leaves=True)["maxDepth"] == 4
    assert models.gbt_params({"num_leaves": 32, "max_depth": 10}, cap_leaves=True)["maxDepth"] == 5
    assert models.gbt_params({"num_leaves": 300, "max_depth": 3}, cap_leaves=True)["maxDepth"] == 3


def test_wide_least_squares_are_absorbed(spark, monkeypatch):
    """with hundreds of categories neither their moments nor their coefficients are gathered, and the fit is that of dense dummies."""
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), f"k{i % 230:03d}" if i % 41 else None, f"s{i % 3}", float((i % 230) * 0.5 + rng.normal())) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, x double, c string, s string, y double")
    dense = features.fit_linear_features(df, ["x", "c", "s"])
    prepared = dense.transform(df, keep=["id", "y"])
    plain = models.fit_ols(prepared, dense.train_columns, "y")
    with monkeypatch.context() as m:
        m.setattr(sparse.SparseFeatures, "counts", property(lambda self: pytest.fail("wide counts gathered") if self.size() > 10 else {c: np.array(self.encoder.counts[c]) for c in self.categorical}))
        model = sparse.fit_sparse_linear(df, ["x", "c", "s"], "y")
        got = {r["id"]: r["prediction"] for r in model.predict(df, ["id"]).collect()}
        entries = {r["entry"]: (r["feature"], r["mean"], r["deviation"]) for r in model.state.entries(spark).collect()}
    assert isinstance(model, sparse.AbsorbedModel)
    want = {r["id"]: r["p"] for r in models.predict(plain, prepared, dense.train_columns, None, keep=["id"]).withColumnRenamed("prediction", "p").collect()}
    assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want) and len(got) == len(want)
    assert [entries[i][0] for i in range(len(entries))] == dense.train_columns
    means, stds = model.state.moments()
    assert np.allclose([entries[i][1] for i in range(len(entries))], means) and np.allclose([entries[i][2] for i in range(len(entries))], stds)
    assert np.allclose(model.coefficients, plain.coefficients.toArray(), atol=1e-6) and model.intercept == pytest.approx(plain.intercept, abs=1e-6)
    table_ = {r["feature"]: r["coefficient"] for r in model.coefficient_table(spark).collect()}
    assert len(table_) == model.state.size() + 1
    new = spark.createDataFrame([(1, 0.0, "never met", "s1", 0.0), (2, 0.0, None, "s1", 0.0), (3, 0.0, "k000", "s1", 0.0)], df.schema)
    assert len({round(r["prediction"], 9) for r in model.predict(new, ["id"]).collect()}) == 1


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_rows_of_equal_features_are_fitted_as_one(spark, monkeypatch, task):
    """Without subsampling, weighted rows give the trees of the single rows."""
    df = spark.range(6000).selectExpr("id", "CAST(id % 5 AS double) AS x", "concat('c', id % 7) AS c", "CAST(xxhash64(id) % 50 AS double) + (id % 5) * (id % 7) AS v")
    df = df.withColumn("y", F.col("v") if task == "regression" else (F.col("v") > 8).cast("double"))
    params, sizes = {"n_estimators": 4, "max_depth": 3, "subsample": 1.0, "colsample_bytree": 1.0}, []
    with monkeypatch.context() as m:
        m.setattr(models, "spread", lambda data, n=None, real=models.spread: sizes.append(data.count()) or real(data, n))
        grouped, state = models.fit_gbt(df, ["x", "c"], "y", task, params)
        m.setattr(models, "grouped_rows", lambda *a: None)
        single, _ = models.fit_gbt(df, ["x", "c"], "y", task, params)
    assert sizes[0] <= 2 * 35 * models.GROUP_UNITS and sizes[1] == 6000
    a, b = (explain.tree_attribution(state.transform(df, keep=["id"]), g, state.columns(), keep=["id"]) for g in (grouped, single))
    a, b = ({r["id"]: tuple(r)[1:] for r in t.collect()} for t in (a, b))
    assert len(a) == 6000 and all(a[i] == pytest.approx(b[i], abs=1e-6) for i in a)
    assert explain._gbt_trees(grouped)[0][0][0]["rawCount"] == 6000


def test_rows_without_repeats_stay_single(spark):
    df = models.assemble(spark.range(500).selectExpr("CAST(id AS double) AS x", "CAST(id % 3 AS double) AS y", "1 AS __unit"), ["x"])
    assert models.grouped_rows(df, "y", "regression") is None


def test_grouped_cross_validation_scores_single_rows(spark, monkeypatch):
    df = spark.range(9000).selectExpr("id", "CAST(id % 6 AS double) AS x", "CAST((id % 6) * 3 + xxhash64(id) % 5 AS double) AS y")
    params = {"n_estimators": 5, "max_depth": 3, "subsample": 1.0, "colsample_bytree": 1.0}
    grouped = evaluate.cv_gbt_scores(df, ["x"], "y", ["id"], params=params, k=2).first()
    monkeypatch.setattr(evaluate, "grouped_rows", lambda *a: None)
    single = evaluate.cv_gbt_scores(df, ["x"], "y", ["id"], params=params, k=2).first()
    assert tuple(grouped) == pytest.approx(tuple(single), abs=1e-9) and grouped["folds"] == 2


def test_partitions_of_a_fit_grow_with_its_rows(spark, monkeypatch):
    """one partition per core held a share of the table that grew with it."""
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(models, "ROWS_PER_TASK", 100)
    data = spark.range(1000 * cores)
    assert models.spread(data, 1000 * cores).rdd.getNumPartitions() == 10 * cores
    assert models.spread(data, 100 * cores).rdd.getNumPartitions() <= cores
    df = spark.range(250 * cores).selectExpr("concat('k', id) AS k", "CAST(id AS double) AS x", "CAST(id % 7 AS double) AS y")
    kept = []
    monkeypatch.setattr(models, "spread", lambda d, n=None, real=models.spread: kept.append(real(d, n)) or kept[-1])
    models.fit_gbt(df, ["x"], "y", "regression", {"n_estimators": 1, "max_depth": 2})
    sizes = kept[0].groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() <= 100 and len(sizes) == 3 * cores
