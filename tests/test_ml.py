import math
import time

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
from pyspark.sql import functions as F

from tableprep.ml import cells, evaluate, explain, features, models
from tableprep.plans import ml_registry
from tableprep.plans.ml_registry import q_random_search
from tableprep.session import scratch_path

from .conftest import SF0001, SF001, rows
from .test_tree_paths import brute


def test_detect_and_recommend(spark):
    df = spark.createDataFrame([(i, i % 2, "s", True, i % 5, float(i)) for i in range(40)],
                               "id long, flag int, s string, b boolean, small int, x double")
    assert features.detect_categoricals(df) == ["flag", "s", "b"]
    rec = {r["column"]: r["recommended"] for r in features.recommend_categoricals(df).collect()}
    assert rec == {"id": False, "small": True, "x": False}


def test_label_encode_numeric_order_and_unseen(spark):
    train = spark.createDataFrame([(10,), (2,), (None,), (2,)], "c int")
    enc = features.fit_label_encoder(train, ["c"])
    assert enc.categories == {"c": [2, 10]}
    score = spark.createDataFrame([(10,), (7,), (None,)], "c int")
    assert [r[0] for r in enc.transform(score).collect()] == [1, None, None]
    assert [r[0] for r in features.fit_label_encoder(train, ["c"], unseen_code=9).transform(score).collect()] == [1, 9, None]


def test_label_encode_dictionary_path_equals_literal_path(spark):
    """Past the literal limit, codes come from the ranged dictionary table;
    they must equal the literal-map codes, also with a hot value holding a
    third of the rows, NULLs, numeric order (2 < 10) and unseen values."""
    rows = [(i, i % 37 if i % 3 else 5, None if i % 11 == 0 else f"s{i % 23}") for i in range(600)]
    train = spark.createDataFrame(rows, "id long, n int, s string")
    lit_enc = features.fit_label_encoder(train, ["n", "s"])
    dict_enc = features.fit_label_encoder(train, ["n", "s"], literal_limit=3)
    assert not lit_enc.dictionaries and set(dict_enc.dictionaries) == {"n", "s"}
    assert dict_enc.dictionary_rows == {"n": 37, "s": 23}
    want = sorted(lit_enc.transform(train).collect())
    assert sorted(dict_enc.transform(train).collect()) == want
    score = spark.createDataFrame([(1, 10, "s3"), (2, 99, "zz"), (3, None, None)], "id long, n int, s string")
    got = {r["id"]: (r["n"], r["s"]) for r in
           features.fit_label_encoder(train, ["n", "s"], unseen_code=-1, literal_limit=3).transform(score).collect()}
    assert got == {1: (lit_enc.categories["n"].index(10), lit_enc.categories["s"].index("s3")),
                   2: (-1, -1), 3: (None, None)}


def test_label_encode_dictionary_shuffle_join(spark, monkeypatch):
    """Above the broadcast bound the dictionary is a shuffle join; a hot
    value holding a third of the rows gets the same codes."""
    rows = [(i, 7 if i % 3 == 0 else i % 101) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, k long")
    want = sorted(features.fit_label_encoder(df, ["k"]).transform(df).collect())
    enc = features.fit_label_encoder(df, ["k"], literal_limit=5)
    assert enc.dictionary_rows == {"k": 101} and enc.dictionary_bytes["k"] > 0 and enc._broadcastable("k")
    monkeypatch.setattr(features, "DICTIONARY_BROADCAST_BYTES", 10)
    assert not enc._broadcastable("k")
    # Spark's own size-based broadcast off too: the join must shuffle
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = enc.transform(df)
        got = sorted(out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
    assert got == want


def test_label_encode_long_texts_use_dictionary(spark, monkeypatch):
    """Few but long values stay out of the plan: past the byte bound the
    column is dictionary-encoded, with the same codes."""
    df = spark.createDataFrame([(i, ("t%d" % (i % 5)) * 200) for i in range(40)], "id long, s string")
    want = sorted(features.fit_label_encoder(df, ["s"]).transform(df).collect())
    monkeypatch.setattr(features, "LITERAL_BYTES", 100)
    enc = features.fit_label_encoder(df, ["s"])
    assert set(enc.dictionaries) == {"s"} and not enc.categories
    assert sorted(enc.transform(df).collect()) == want


def test_label_encoder_save_load(spark, tmp_path):
    train = spark.createDataFrame([(i, f"v{i % 7}") for i in range(50)], "id long, s string")
    enc = features.fit_label_encoder(train, ["id", "s"], literal_limit=10)
    assert set(enc.dictionaries) == {"id"} and enc.categories["s"][0] == "v0"
    enc.save(str(tmp_path / "enc"))
    back = features.LabelEncoderModel.load(spark, str(tmp_path / "enc"))
    assert sorted(back.transform(train).collect()) == sorted(enc.transform(train).collect())


def test_one_hot_and_align(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "s string, x double")
    lf = features.fit_linear_features(train, ["s", "x"])
    assert lf.train_columns == ["x", "s_b", "s_c"]
    score = spark.createDataFrame([("b", 2.0), ("z", 2.0), (None, 2.0)], "s string, x double")
    out = lf.transform(score).collect()
    # x standardised with population sigma; unseen / NULL category -> all-zero dummies (then scaled)
    mu, sd = 2.0, math.sqrt(2.0 / 3.0)
    assert out[0]["x"] == pytest.approx((2.0 - mu) / sd)
    assert out[1]["s_b"] == out[2]["s_b"] == pytest.approx((0 - 1 / 3) / math.sqrt(2 / 9))
    back = features.LinearFeaturesModel.from_json(lf.to_json())
    assert back.train_columns == lf.train_columns


def test_scaler_zero_variance(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "c double")
    sc = features.fit_scaler(df, ["c"])
    assert sc.stds["c"] == 1.0 and [r[0] for r in sc.transform(df).collect()] == [0.0, 0.0]


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 3 + x @ np.array([2.0, -1.0]) + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    m = models.fit_ols(df, ["a", "b"], "y")
    coef, *_ = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)
    assert m.intercept == pytest.approx(coef[0]) and list(m.coefficients) == pytest.approx(list(coef[1:]))
    pred = models.predict(m, df, ["a", "b"], "y")
    r2 = evaluate.r2_score(pred, "y", "predicted_y").collect()[0][0]
    assert r2 == pytest.approx(m.summary.r2)


def test_logistic_and_accuracy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    y = (x + rng.normal(scale=0.5, size=300) > 0).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    m = models.fit_logistic(df, ["x"], "y", C=1.0)
    assert m.coefficients[0] > 0
    pred = models.predict(m, df, ["x"], "y")
    acc = evaluate.accuracy_score(pred, "y", "predicted_y").collect()[0][0]
    assert acc > 0.8


def test_gbt_params_mapping():
    sp = models.gbt_params({"max_depth": 50, "colsample_bytree": 1.0})
    assert sp["maxDepth"] == 30 and sp["featureSubsetStrategy"] == "all" and sp["maxIter"] == 100
    with pytest.raises(ValueError):
        models.gbt_params({"reg_alpha": 0.5})


def test_tree_attribution_exact(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").limit(3000).withColumn("rid", F.monotonically_increasing_id())
    li = li.persist()
    feats = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
    model, state = models.fit_gbt(li, feats, "l_extendedprice", "regression",
                                  {"n_estimators": 4, "max_depth": 3}, categoricals=["l_returnflag"])
    x = state.transform(li, keep=["rid"])
    att = explain.tree_attribution(x, model, state.columns(), keep=["rid"]).toPandas().set_index("rid")
    pred = models.predict(model, li, feats, "y", keep=["rid"], tree_state=state).toPandas().set_index("rid")
    contrib = att[[c for c in att.columns if c.endswith("_contrib")]]
    assert np.allclose(contrib.sum(axis=1) + att["base_value"], pred.loc[att.index, "predicted_y"], atol=1e-6)
    # brute force on a few rows
    trees, weights = explain._gbt_trees(model)
    xs = x.toPandas().set_index("rid")
    for rid in list(att.index[:3]):
        vec = xs.loc[rid, state.columns()].to_numpy(dtype=float)
        phi, base = brute(trees, weights, vec)
        assert np.allclose(phi, contrib.loc[rid].to_numpy(), atol=1e-6)
        assert base == pytest.approx(att.loc[rid, "base_value"])


def test_tree_attribution_refuses_a_model_too_large_to_send(spark, monkeypatch):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").limit(500)
    model, state = models.fit_gbt(li, ["l_quantity"], "l_extendedprice", "regression", {"n_estimators": 2, "max_depth": 3})
    monkeypatch.setattr(explain, "MAX_TREE_BYTES", 100)
    with pytest.raises(ValueError, match="MAX_TREE_BYTES"):
        explain.tree_attribution(state.transform(li), model, state.columns())


def test_bundle_roundtrip(spark):
    df = spark.createDataFrame([(float(i), float(2 * i + 1)) for i in range(20)], "x double, y double")
    m = models.fit_ols(df, ["x"], "y")
    path = scratch_path(spark, "bundle")
    models.save_bundle(path, m, {"features": ["x"], "target": "y"})
    m2, meta = models.load_bundle(path, LinearRegressionModel)
    assert meta["features"] == ["x"]
    a = rows(models.predict(m, df, ["x"], "y"))
    b = rows(models.predict(m2, df, ["x"], "y"))
    assert a == b


def test_cv_and_search(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), float(3 * i + (i % 7))) for i in range(200)],
                               "a double, b double, y double").withColumn("k", F.monotonically_increasing_id())
    cv = evaluate.cv_scores(df, ["a", "b"], "y", ["k"], k=3).collect()[0]
    assert cv["cv_mean"] > 0.99
    trials = evaluate.draw_trials(3, seed=1)
    assert trials == evaluate.draw_trials(3, seed=1) and len(trials) == 3
    assert all(100 <= t["n_estimators"] <= 1000 and 3 <= t["max_depth"] <= 10 for t in trials)


def test_registered_search_is_the_whole_one(spark, monkeypatch):
    """20 trials of 5 folds, every parameter drawn from its range and none pinned; the fits themselves are left out."""
    fitted = []
    monkeypatch.setattr(evaluate, "gbt_estimator", lambda label, task, params, bins, classes: fitted.append(params) or params)
    monkeypatch.setattr(evaluate, "_fold_score", lambda data, estimator, evaluator, fold: 0.95 + estimator["learning_rate"] / 100)
    got = q_random_search(spark, SF001).collect()
    assert sorted(r["trial"] for r in got) == list(range(20))
    for name, low, high, *_ in evaluate.SEARCH_SPACE:
        if name != "num_leaves":
            seen = [r[name] for r in got]
            assert len(set(seen)) > 1 and low <= min(seen) <= max(seen) <= high
            assert sorted(seen * 5) == sorted(t[name] for t in fitted) and {r["folds"] for r in got} == {5}


def test_search_scores_every_fold_of_bad_trials_too(spark, monkeypatch):
    """A trial that cannot become the best after its first fold keeps all its folds, mean and deviation."""
    df = spark.createDataFrame([(i, float(i % 17), float(i % 2)) for i in range(60)], "id long, a double, y double")
    trials, ran = evaluate.draw_trials(4), []
    monkeypatch.setattr(evaluate, "gbt_estimator", lambda label, task, params, bins, classes: params)

    def score(data, estimator, evaluator, fold):
        trial = [t["learning_rate"] for t in trials].index(estimator["learning_rate"])
        ran.append((trial, fold))
        return 0.9 if trial == 0 else -5.0 - fold

    monkeypatch.setattr(evaluate, "_fold_score", score)
    for parallelism in (1, 4):
        ran.clear()
        got = evaluate.random_search(df, ["a"], "y", ["id"], task="classification", n_trials=4, k=3, parallelism=parallelism).collect()
        assert sorted(ran) == [(t, f) for t in range(4) for f in range(3)]
        assert [(r["trial"], r["folds"]) for r in got] == [(0, 3), (1, 3), (2, 3), (3, 3)]
        assert [(r["cv_mean"], r["cv_std"]) for r in got[1:]] == [(pytest.approx(-6), pytest.approx(1))] * 3


def noisy_classes(spark, n=1_500):
    """Continuous features of more values than bins, and a label that depends on both."""
    rng = np.random.default_rng(3)
    a, b, flip = rng.normal(size=n), rng.integers(0, 6, n), rng.uniform(size=n) < 0.15
    y = ((a * a + b / 3 > 1.6) ^ flip).astype(float)
    return spark.createDataFrame([(i, float(a[i]), float(b[i]), float(y[i])) for i in range(n)], "id long, a double, b double, y double")


def test_fits_of_a_search_over_cells_are_those_of_spark(spark, monkeypatch):
    """Each fold's score is the one of Spark's own boosted trees, and no fit runs a job per tree level."""
    df, over = noisy_classes(spark), {"n_estimators": 12, "subsample": 1.0, "colsample_bytree": 1.0}
    trials = evaluate.draw_trials(3, overrides=over)
    want = [evaluate.cv_gbt_scores(df, ["a", "b"], "y", ["id"], task="classification", params={n: v for n, v in t.items() if n != "num_leaves"}, k=3).first() for t in trials]

    def fit(self, *args):
        raise AssertionError("a fit of Spark ML")

    monkeypatch.setattr("pyspark.ml.classification.GBTClassifier.fit", fit)
    got = evaluate.random_search(df, ["a", "b"], "y", ["id"], task="classification", n_trials=3, k=3, overrides=over).collect()
    for r in got:
        assert (r["cv_mean"], r["cv_std"]) == (pytest.approx(want[r["trial"]]["cv_mean"], abs=2e-3), pytest.approx(want[r["trial"]]["cv_std"], abs=2e-3))


def test_cells_count_every_row_once_and_repeats_alike(spark):
    """The cells of a fold hold each row as a training or a scored one; three copies of the rows are three times the counts."""
    df = noisy_classes(spark, 400).withColumn("fold", F.col("id") % 3)
    x = models.assemble(df, ["a", "b"])
    once, thrice = (cells.fold_cells(d, "features", "y", 3, 32) for d in (x, x.union(x).union(x).repartition(7)))
    for i, ((binned, sizes, counts), (binned3, sizes3, counts3)) in enumerate(zip(once.folds, thrice.folds)):
        assert sizes == sizes3 and sizes[0] == 32 and (binned == binned3).all() and all((3 * c == c3).all() for c, c3 in zip(counts, counts3))
        held = df.groupBy((F.col("fold") == i).alias("t"), "y").count().collect()
        assert {(r["t"], r["y"]): r["count"] for r in held} == {(t, y): int(c.sum()) for (t, y), c in zip([(False, 1.0), (False, 0.0), (True, 1.0), (True, 0.0)], counts)}


def test_rows_that_are_no_cells_are_left_to_spark(spark, monkeypatch):
    df = noisy_classes(spark, 60).withColumn("fold", F.col("id") % 2)
    x = models.assemble(df, ["a", "b"])
    assert cells.fold_cells(x, "features", "y", 2, 32) is not None
    assert cells.fold_cells(x.withColumn("y", F.expr("IF(id = 7, NULL, y)")), "features", "y", 2, 32) is None
    assert cells.fold_cells(x.withColumn("y", F.col("y") + 1), "features", "y", 2, 32) is None
    codes = models.fit_tree_features(df, ["a", "b"], ["b"]).transform(df, keep=["y", "fold"])
    assert cells.fold_cells(models.assemble(codes, ["a", "b"]), "features", "y", 2, 32) is None
    monkeypatch.setattr(cells, "MAX_VALUES", 50)
    assert cells.fold_cells(x, "features", "y", 2, 32) is None


def test_subsampled_cells_find_the_classes(spark):
    binned, positive = np.arange(20)[:, None], np.array([0, 90] * 10)
    p = {"trees": 60, "step": 0.3, "depth": 5, "rate": 0.6, "seed": 1, "features": 0.7, "min_rows": 1, "min_gain": 0.0}
    margin = cells.boosted_margins(binned, [20], positive, positive[::-1], p)
    assert ((margin > 0) == (positive > 0)).all()
    assert (cells.boosted_margins(binned, [20], positive, positive[::-1], p) == margin).all()


def serial_search(scores):
    """One trial after another, given up once perfect scores on the rest could not reach the best mean so far."""
    out, best, k = [], None, len(scores[0])
    for folds in scores:
        for done in range(1, k):
            if best is not None and (sum(folds[:done]) + k - done) / k < best:
                out.append((None, None, done))
                break
        else:
            out.append((float(np.mean(folds)), float(np.std(folds, ddof=1)), k))
            best = max(best, out[-1][0]) if best is not None else out[-1][0]
    return out


@pytest.mark.parametrize("seed, spread", [(0, 0.02), (1, 0.3), (2, 2.0), (3, 5.0)])
def test_concurrent_search_reports_what_the_serial_one_does(spark, seed, spread):
    rng = np.random.default_rng(seed)
    scores = (1 - rng.uniform(size=(12, 1)) * spread * rng.uniform(size=(12, 5))).tolist()
    want, ran = serial_search(scores), []

    def score(trial, fold):
        time.sleep(float(rng.uniform(0, 0.02)))
        ran.append((trial, fold))
        return scores[trial][fold]

    for parallelism in (1, 8):
        ran.clear()
        got = evaluate.search_folds(spark, 12, 5, score, parallelism)
        assert got == want and len(set(ran)) == len(ran)
        assert {(t, f) for t, (_, _, n) in enumerate(want) for f in range(n)} <= set(ran)
        best = max(range(12), key=lambda t: np.mean(scores[t]))
        assert max((m, -t) for t, (m, _, _) in enumerate(got) if m is not None)[1] == -best
        if parallelism == 1:
            assert len(ran) == sum(n for _, _, n in want)


def test_hopeless_trials_are_cancelled_and_errors_raised(spark):
    def score(trial, fold):
        if trial == 0:
            time.sleep(0.5)
            return 0.9
        if fold == 1:
            spark.range(10 ** 12).selectExpr("sum(id % 7)").collect()  # hours, unless cancelled
        return -5.0

    began = time.monotonic()
    assert evaluate.search_folds(spark, 2, 3, score, 6) == [(pytest.approx(0.9), pytest.approx(0), 3), (None, None, 1)]
    assert time.monotonic() - began < 60

    def broken(trial, fold):
        raise RuntimeError("no fit")

    with pytest.raises(RuntimeError, match="no fit"):
        evaluate.search_folds(spark, 2, 3, broken, 2)


def test_search_of_a_small_space_equals_its_folds_alone(spark):
    df = spark.createDataFrame([(i, float(i % 17), float(i % 5), float((i % 17 > 8) ^ (i % 5 > 2))) for i in range(300)], "id long, a double, b double, y double")
    over = {"n_estimators": 4, "max_depth": 3, "subsample": 1.0, "colsample_bytree": 1.0}
    got = evaluate.random_search(df, ["a", "b"], "y", ["id"], task="classification", n_trials=3, k=3, overrides=over).collect()
    trials = evaluate.draw_trials(3, overrides=over)
    for r in got:
        params = {n: v for n, v in trials[r["trial"]].items() if n != "num_leaves"}
        alone = evaluate.cv_gbt_scores(df, ["a", "b"], "y", ["id"], task="classification", params=params, k=3).first()
        assert r["folds"] == 3 and r["cv_mean"] == pytest.approx(alone["cv_mean"]) and r["cv_std"] == pytest.approx(alone["cv_std"])
    assert [r["cv_mean"] for r in got] == sorted((r["cv_mean"] for r in got), reverse=True)


@pytest.mark.parametrize("name", ["feature_importance", "importance_total", "tree_attribution", "tree_attribution_sums", "tree_attribution_multiclass"])
def test_registered_explanations_fit_at_the_defaults(spark, monkeypatch, name):
    class Fitted(Exception):
        pass

    def fit(df, features, label, task, params=None, **more):
        raise Fitted(models.gbt_params(params))

    monkeypatch.setattr(models, "fit_gbt", fit)
    with pytest.raises(Fitted) as seen:
        getattr(ml_registry, f"q_{name}")(spark, SF0001)
    assert (seen.value.args[0]["maxIter"], seen.value.args[0]["maxDepth"]) == (100, 7)


def test_validate_params_and_feature_columns(spark):
    assert models.validate_model_parameters({"learning_rate": 0.1, "n_estimators": 100, "max_depth": 7})
    assert not models.validate_model_parameters({"learning_rate": 0.1, "n_estimators": 100})
    assert not models.validate_model_parameters({"learning_rate": 0, "n_estimators": 100, "max_depth": 7})
    assert not models.validate_model_parameters({"learning_rate": "0.1", "n_estimators": 100, "max_depth": 7})
    df = spark.createDataFrame([(0, 1.0, 2.0, 1)], "index long, a double, b double, y int")
    assert features.feature_columns(df, "y") == ("index", ["a", "b"])


def test_multiclass_paths(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = np.digitize(x[:, 0] + 0.1 * rng.normal(size=300), [-0.5, 0.5])
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    gbt, state = models.fit_gbt(df, ["a", "b"], "y", "classification", {"n_estimators": 5, "max_depth": 3})
    pred = models.predict(gbt, df, ["a", "b"], "y", tree_state=state)
    assert evaluate.accuracy_score(pred, "y", "predicted_y").collect()[0][0] > 0.8
    # one row per (row, class); base + contributions = that class's margin
    x = state.transform(df.withColumn("rid", F.monotonically_increasing_id()), keep=["rid"])
    att = explain.tree_attribution(x, gbt, state.columns(), keep=["rid"]).toPandas()
    assert sorted(att["class"].unique()) == [0, 1, 2] and len(att) == 3 * 300
    assembled = models.assemble(x, state.columns())
    for ci, m in enumerate(gbt.models):
        margin = {r["rid"]: float(r["rawPrediction"][1]) for r in m.transform(assembled).select(
            "rid", "rawPrediction").collect()}
        part = att[att["class"] == ci].set_index("rid")
        total = part[[c for c in part.columns if c.endswith("_contrib")]].sum(axis=1) + part["base_value"]
        assert np.allclose(total.to_numpy(), [margin[r] for r in part.index], atol=1e-6)
    lr = models.fit_logistic(df, ["a", "b"], "y")
    tab = models.coefficient_table(lr, ["a", "b"])
    assert tab.count() == 9
    ext = explain.coefficient_extremes(tab, k=2).collect()
    assert len(ext) == 4 and all(not r["feature"].startswith("(intercept)") for r in ext)


def test_r2_leaves_rows_without_prediction_out(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (3.0, None), (100.0, None)], "y double, p double")
    assert evaluate.r2_score(df, "y", "p").first()[0] == pytest.approx(0.5)


def test_default_classifier_of_cv(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 10 > 4)) for i in range(300)], "id long, x double, y double")
    row = evaluate.cv_scores(df, ["x"], "y", ["id"], task="classification", k=3).first()
    assert row.cv_mean > 0.95 and row.folds == 3


def test_cv_of_boosted_trees_with_categories_and_classes(spark):
    df = spark.createDataFrame([(i, f"c{i % 40}", float(i % 40 % 3)) for i in range(400)], "id long, c string, y double")
    row = evaluate.cv_gbt_scores(df, ["c"], "y", ["id"], task="classification", params={"n_estimators": 3, "max_depth": 6, "subsample": 1.0, "colsample_bytree": 1.0}, k=2).first()
    assert row.cv_mean > 0.6


def test_tree_features_survive_saving(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a", 1.0), (None, "b", 2.0), (3.0, None, 3.0)], "x double, c string, y double")
    state = models.fit_tree_features(df, ["x", "c"])
    state.save(str(tmp_path / "s"), spark)
    again = models.TreeFeatures.load(spark, str(tmp_path / "s"))
    assert again.transform(df).collect() == state.transform(df).collect()


def test_missing_features_fail_scoring_unless_told(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.5)], "x double, y double")
    m = models.fit_ols(df, ["x"], "y")
    bad = spark.createDataFrame([(None, 1.0)], "x double, y double")
    with pytest.raises(Exception):
        models.predict(m, bad, ["x"], "y").collect()
    assert models.predict(m, bad, ["x"], "y", handle_invalid="skip").count() == 0


def test_label_encoding_of_decimals_dates_and_zeros(spark):
    df = spark.sql("SELECT CAST(a AS DECIMAL(6,2)) AS a, DATE(b) AS b, CAST(c AS DOUBLE) AS c FROM VALUES (2.5, '2024-01-02', 0.0), (1.5, '2024-01-01', -0.0D), (2.5, '2024-01-02', 1.0) AS t(a, b, c)")
    for limit in (None, 0):
        out = features.fit_label_encoder(df, ["a", "b", "c"], literal_limit=limit).transform(df)
        assert sorted(map(tuple, out.collect())) == [(0, 0, 0), (1, 1, 0), (1, 1, 1)]


def test_category_limits_are_parameters(spark):
    df = spark.createDataFrame([(f"c{i:05d}", float(i % 7)) for i in range(10_050)], "c string, y double")
    with pytest.raises(ValueError, match="more than 10000"):
        features.fit_one_hot(df, ["c"])
    assert len(features.fit_one_hot(df, ["c"], max_categories=20_000).categories["c"]) == 10_050
    assert models.fit_tree_features(df, ["c"], max_categories=20_000).max_bins() == 10_051


def many_rows(spark):
    """5,000 rows of a continuous number, few numbers and a category; the target depends on all."""
    rng = np.random.default_rng(8)
    a, b, c = rng.normal(size=5_000), rng.integers(0, 3, 5_000), rng.integers(0, 2, 5_000)
    return spark.createDataFrame([(i, float(a[i]), float(b[i]), f"c{c[i]}", float(np.sin(2 * a[i]) + b[i] * c[i])) for i in range(5_000)], "id long, a double, b double, c string, y double")


def test_large_tables_are_fitted_by_their_bins(spark, monkeypatch):
    """Rows of equal bins are one weighted row; every row counts and is scored as close as by the rows themselves."""
    df, sizes = many_rows(spark), []
    p = {"n_estimators": 15, "max_depth": 5, "subsample": 1.0, "colsample_bytree": 1.0}

    def error():
        model, state = models.fit_gbt(df, ["a", "b", "c"], "y", params=p)
        out = models.predict(model, df, ["a", "b", "c"], "y", keep=["id", "y"], tree_state=state)
        return out.agg(F.avg(F.pow(F.col("y") - F.col("predicted_y"), 2)), F.count("*")).first(), state

    (alone, n), state = error()
    assert n == 5_000 and not state.cuts
    monkeypatch.setattr(models, "BIN_ROWS", 1_000)
    monkeypatch.setattr(models, "GROUP_UNITS", 2)
    real = models.grouped_rows

    def grouped(data, label, task, keys=()):
        out = real(data, label, task, keys)
        if out is not None:
            sizes.append(out.agg(F.count("*"), F.sum(models.WEIGHT)).first())
        return out

    monkeypatch.setattr(models, "grouped_rows", grouped)
    (binned, n), state = error()
    assert n == 5_000 and len(sizes) == 1 and sizes[0][0] <= 32 * 3 * 2 * 2 and sizes[0][1] == 5_000
    assert len(state.cuts["a"]) == 31 and state.cuts["b"] == [0.5, 1.5] and "c" not in state.cuts
    assert binned == pytest.approx(alone, abs=0.01)


def test_bins_hold_equal_shares_and_survive_saving(spark, tmp_path):
    df = many_rows(spark)
    cuts = models.fit_cuts(df, ["a", "b"], 8)
    state = models.TreeFeatures(["a", "b"], cuts=cuts)
    got = {r["a"]: r["count"] for r in state.transform(df).groupBy("a").count().collect()}
    assert sorted(got) == [float(i) for i in range(8)] and all(abs(n - 625) <= 10 for n in got.values())
    edges = spark.createDataFrame([(c,) for c in [-math.inf, *cuts["a"], math.inf]], "a double")
    assert [r[0] for r in edges.select(models.bin_of(F.col("a"), cuts["a"])).collect()] == [0.0, *map(float, range(7)), 7.0]
    state.save(str(tmp_path / "s"), spark)
    again = models.TreeFeatures.load(spark, str(tmp_path / "s"))
    assert rows(again.transform(df)) == rows(state.transform(df))


def test_wide_ordered_categories_need_no_dictionary(spark, monkeypatch):
    """A category far over the limit is ordered without a dictionary; its training numbers leave out the row's own fold, whether a unit stands beside it or not."""
    df = spark.createDataFrame([(i, f"k{i % 900}", float(i % 900 + i % 7)) for i in range(3_600)], "id long, k string, y double")
    want = models.fit_target_order(df, "k", "y")
    encoded, real = [], models.fit_label_encoder
    monkeypatch.setattr(models, "fit_label_encoder", lambda d, columns: encoded.extend(columns) or real(d, columns))
    state = models.fit_tree_features(df, ["k"], label="y", nominal=200)
    assert encoded == [] and list(state.ordered) == ["k"] and rows(state.ordered["k"].table, "value", "n", "s") == rows(want.table, "value", "n", "s")
    plain = rows(state.transform(df, keep=["id"], label="y"))
    assert rows(state.transform(df.withColumn(models.UNIT, models.row_unit(df)), keep=["id"], label="y")) == plain
    folds = {(r["value"], f): (v["n"], v["s"]) for r in state.ordered["k"].table.collect() for f, v in r["folds"].items()}
    by_hand = df.groupBy("k", models.row_fold(df).alias("f")).agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()
    assert folds == {(r["k"], r["f"]): (r["n"], r["s"]) for r in by_hand}


def test_attribution_of_repeated_rows_is_made_once(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 5), float(i % 3), i % 3) for i in range(300)], "id long, a double, b double, y int")
    model, state = models.fit_gbt(df, ["a", "b"], "y", "classification", {"n_estimators": 4, "max_depth": 3})
    x, explained, real = state.transform(df, keep=["id"]), [], explain._explained
    monkeypatch.setattr(explain, "_explained", lambda d, *more: explained.append(d.count()) or real(d, *more))
    once = rows(explain.tree_attribution(x, model, ["a", "b"], keep=["id", "a"]))
    monkeypatch.setattr(explain, "SAME_GAIN", 10 ** 9)
    alone = rows(explain.tree_attribution(x, model, ["a", "b"], keep=["id", "a"]))
    assert explained == [15, 300] and len(once) == 900 and np.allclose(once, alone)
