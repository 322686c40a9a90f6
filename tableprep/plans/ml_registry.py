"""Registered model queries: feature preparation (L1-L8), fits (M1-M3),
metrics (M8, M9), CV / search (M4, M5), scoring (M6) and explanations
(M10-M12, O3, O4).  Fits that SQL cannot express are rows-only.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..ml import evaluate, explain, features, models, sparse, stages
from ..operators import sampling
from ..session import scratch_path
from ..sources import files
from .registry import R, register, rnd, table


# ---------------------------------------------------------------- detection

@register("detect_categoricals", """SELECT 'doc_id' AS "column",
  count(doc_id) > 0 AND bool_and(doc_id IN (0, 1)) AS is_categorical FROM labels
UNION ALL SELECT 'quality', count(quality) > 0 AND bool_and(quality IN (0, 1)) FROM labels
UNION ALL SELECT 'toxic', count(toxic) > 0 AND bool_and(toxic IN (0, 1)) FROM labels""")
def q_detect_categoricals(spark, d):
    return features.categorical_report(table(spark, d, "labels"))


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax"]


@register("recommend_categoricals", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count({c}) > 0 AND count(DISTINCT {c}) BETWEEN 2 AND 50
  AND count(DISTINCT {c}) <= 0.3 * count({c}) AS recommended FROM lineitem""" for c in _LI_NUM))
def q_recommend_categoricals(spark, d):
    rep = features.recommend_categoricals(table(spark, d, "lineitem"))
    return rep.select("column", "recommended")


# ---------------------------------------------------------------- encoders / scaler

@register("label_encode", """SELECT o_orderkey,
  CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority FROM orders""")
def q_label_encode(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return features.fit_label_encoder(o, ["o_orderpriority"]).transform(o)


@register("label_encode_wide", """SELECT l_orderkey AS orderkey, l_linenumber,
  CAST(dense_rank() OVER (ORDER BY l_orderkey) - 1 AS INTEGER) AS l_orderkey,
  CAST(dense_rank() OVER (ORDER BY l_partkey) - 1 AS INTEGER) AS l_partkey FROM lineitem""")
def q_label_encode_wide(spark, d):
    """L3 on every lineitem row: ``l_orderkey`` has more values than
    ``features.LITERAL_CATEGORIES`` (from sf0.01 up), so it is encoded
    through the exact dictionary table; ``l_partkey`` stays a literal map."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_linenumber",
                                            "l_orderkey", "l_partkey")
    return features.fit_label_encoder(li, ["l_orderkey", "l_partkey"]).transform(li)


@register("one_hot", """SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS o_orderstatus_O,
  CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END::DOUBLE AS o_orderstatus_P FROM orders""")
def q_one_hot(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return features.fit_one_hot(o, ["o_orderstatus"]).transform(o)


@register("standardize", f"""SELECT l_orderkey, l_linenumber,
  round((l_quantity - avg(l_quantity) OVER ()) / coalesce(nullif(stddev_pop(l_quantity) OVER (), 0), 1), {R}) AS l_quantity,
  round((l_extendedprice - avg(l_extendedprice) OVER ())
        / coalesce(nullif(stddev_pop(l_extendedprice) OVER (), 0), 1), {R}) AS l_extendedprice FROM lineitem""")
def q_standardize(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    scaler = features.fit_scaler(li, ["l_quantity", "l_extendedprice"])
    out = scaler.transform(li)
    return out.select("l_orderkey", "l_linenumber", rnd("l_quantity"), rnd("l_extendedprice"))


# p_type categories of the test data (first one is dropped).
_P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _linear_features_sql():
    cols = ["p_size", "p_retailprice"] + [f"p_type_{t}" for t in _P_TYPES[1:]]
    dummies = ", ".join(f"CASE WHEN p_type = '{t}' THEN 1.0 ELSE 0.0 END::DOUBLE AS p_type_{t}"
                        for t in _P_TYPES[1:])
    z = ", ".join(f"round((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), {R})"
                  f" AS {c}" for c in cols)
    return f"SELECT p_partkey, {z} FROM (SELECT p_partkey, p_size, p_retailprice, {dummies} FROM part) t"


@register("linear_features", _linear_features_sql())
def q_linear_features(spark, d):
    p = table(spark, d, "part")
    lf = features.fit_linear_features(p, ["p_size", "p_retailprice", "p_type"])
    out = lf.transform(p, keep=["p_partkey"])
    return out.select("p_partkey", *[rnd(c) for c in out.columns[1:]])


# ---------------------------------------------------------------- linear models

@register("ols_univariate", f"""SELECT round(regr_intercept(l_extendedprice, l_quantity), {R}) AS intercept,
  round(regr_slope(l_extendedprice, l_quantity), {R}) AS slope,
  round(regr_r2(l_extendedprice, l_quantity), {R}) AS r2 FROM lineitem""")
def q_ols_univariate(spark, d):
    li = table(spark, d, "lineitem")
    m = models.fit_ols(li, ["l_quantity"], "l_extendedprice")
    row = [(float(m.intercept), float(m.coefficients[0]), float(m.summary.r2))]
    out = spark.createDataFrame(row, "intercept double, slope double, r2 double")
    return out.select(rnd("intercept"), rnd("slope"), rnd("r2"))


@register("ols_multi", f"""WITH s AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2,
  var_pop(l_quantity) AS v1, var_pop(l_discount) AS v2, covar_pop(l_quantity, l_discount) AS c12,
  covar_pop(l_quantity, l_extendedprice) AS c1y, covar_pop(l_discount, l_extendedprice) AS c2y FROM lineitem),
b AS (SELECT *, (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) AS b1,
  (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) AS b2 FROM s)
SELECT round(my - b1 * m1 - b2 * m2, 4) AS intercept, round(b1, 4) AS b_quantity,
  round(b2, 4) AS b_discount FROM b""")
def q_ols_multi(spark, d):
    li = table(spark, d, "lineitem")
    m = models.fit_ols(li, ["l_quantity", "l_discount"], "l_extendedprice")
    row = [(float(m.intercept), float(m.coefficients[0]), float(m.coefficients[1]))]
    out = spark.createDataFrame(row, "intercept double, b_quantity double, b_discount double")
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@register("r2_score", f"""SELECT round(1 - sum((l_extendedprice - l_quantity * 2000) ^ 2)
  / (var_pop(l_extendedprice) * count(l_extendedprice)), {R}) AS r2 FROM lineitem""")
def q_r2_score(spark, d):
    li = table(spark, d, "lineitem").withColumn("pred", F.col("l_quantity") * 2000)
    return evaluate.r2_score(li, "l_extendedprice", "pred").select(rnd("r2"))


@register("accuracy_score", f"""SELECT round(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END), {R}) AS accuracy
  FROM labels""")
def q_accuracy_score(spark, d):
    lb = table(spark, d, "labels").withColumn("pred", 1 - F.col("toxic"))
    return evaluate.accuracy_score(lb, "quality", "pred").select(rnd("accuracy"))


@register("linear_attribution", """SELECT l_orderkey, l_linenumber,
  round(regr_slope(l_extendedprice, l_quantity) OVER () * (l_quantity - avg(l_quantity) OVER ()), 2) AS l_quantity_contrib,
  round(regr_intercept(l_extendedprice, l_quantity) OVER ()
        + regr_slope(l_extendedprice, l_quantity) OVER () * avg(l_quantity) OVER (), 2) AS base_value FROM lineitem""")
def q_linear_attribution(spark, d):
    li = table(spark, d, "lineitem")
    m = models.fit_ols(li, ["l_quantity"], "l_extendedprice")
    mean = li.agg(F.avg("l_quantity")).collect()[0][0]
    out = explain.linear_attribution(li, {"l_quantity": float(m.coefficients[0])}, float(m.intercept),
                                     {"l_quantity": float(mean)}, keep=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity_contrib", 2).alias("l_quantity_contrib"),
                      F.round("base_value", 2).alias("base_value"))


# ---------------------------------------------------------------- rows-only fits

def _docs_labelled(spark, d):
    """labels joined to documents: features n_chars, lang, source; targets quality, toxic."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    return table(spark, d, "labels").join(docs, "doc_id")


@register("logistic_fit")
def q_logistic_fit(spark, d):
    data = _docs_labelled(spark, d)
    lf = features.fit_linear_features(data, ["n_chars", "lang", "source"])
    x = lf.transform(data, keep=["doc_id", "quality"])
    m = models.fit_logistic(x, lf.train_columns, "quality", C=1.0)
    return models.coefficient_table(m, lf.train_columns)


# The registered fits and explanations use the form's defaults (100 trees of depth 7).
_LI_FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag"]


@register("gbt_regression")
def q_gbt_regression(spark, d):
    li = table(spark, d, "lineitem")
    model, state = models.fit_gbt(li, _LI_FEATS, "l_extendedprice", "regression", categoricals=["l_returnflag"])
    return models.predict(model, li, _LI_FEATS, "l_extendedprice", keep=["l_orderkey", "l_linenumber"],
                          tree_state=state)


@register("gbt_classification")
def q_gbt_classification(spark, d):
    """Fit on the labelled documents, score every document."""
    feats = ["n_chars", "lang", "source"]
    model, state = models.fit_gbt(_docs_labelled(spark, d), feats, "quality", "classification")
    return models.predict(model, table(spark, d, "documents"), feats, "quality", keep=["doc_id"], tree_state=state)


@register("cv_scores")
def q_cv_scores(spark, d):
    li = table(spark, d, "lineitem")
    return evaluate.cv_scores(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice",
                              ["l_orderkey", "l_linenumber"], k=5)


@register("random_search")
def q_random_search(spark, d):
    data = _docs_labelled(spark, d)
    state = models.fit_tree_features(data, ["n_chars", "lang", "source"])
    x = state.transform(data, keep=["doc_id", "quality"])
    return evaluate.random_search(x, state.columns(), "quality", ["doc_id"], task="classification")


@register("score_table")
def q_score_table(spark, d):
    li = table(spark, d, "lineitem")
    train, hold = sampling.hash_split(li, ["l_orderkey", "l_linenumber"], 80)
    feats = ["l_quantity", "l_discount", "l_tax"]
    m = models.fit_ols(train, feats, "l_extendedprice")
    return models.predict(m, hold, feats, "l_extendedprice")


@register("feature_importance")
def q_feature_importance(spark, d):
    li = table(spark, d, "lineitem")
    model, state = models.fit_gbt(li, _LI_FEATS, "l_extendedprice", "regression",
                                  categoricals=["l_returnflag"])
    return explain.feature_importance(model, state.columns(), top=20)


@register("coefficient_extremes")
def q_coefficient_extremes(spark, d):
    p = table(spark, d, "part")
    lf = features.fit_linear_features(p, ["p_size", "p_type", "p_brand"])
    x = lf.transform(p, keep=["p_retailprice"])
    m = models.fit_ols(x, lf.train_columns, "p_retailprice")
    return explain.coefficient_extremes(models.coefficient_table(m, lf.train_columns), k=10)


@register("tree_attribution")
def q_tree_attribution(spark, d):
    li = table(spark, d, "lineitem")
    model, state = models.fit_gbt(li, _LI_FEATS, "l_extendedprice", "regression",
                                  categoricals=["l_returnflag"])
    x = state.transform(li, keep=["l_orderkey", "l_linenumber"])
    return explain.tree_attribution(x, model, state.columns(), keep=["l_orderkey", "l_linenumber"])


@register("tree_attribution_multiclass")
def q_tree_attribution_multiclass(spark, d):
    """M12 for a three-class target: ``o_orderstatus`` label-encoded, one
    boosted ensemble per class (one-vs-rest), every order explained per class."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority",
                                         "o_orderstatus")
    data = features.fit_label_encoder(o, ["o_orderstatus"]).transform(o)
    feats = ["o_totalprice", "o_custkey", "o_orderpriority"]
    model, state = models.fit_gbt(data, feats, "o_orderstatus", "classification")
    x = state.transform(data, keep=["o_orderkey"])
    return explain.tree_attribution(x, model, state.columns(), keep=["o_orderkey"])


# ---------------------------------------------------------------- fits held against closed forms and invariants

_FOLD_SQL = "CAST('0x' || substr(md5('42' || '|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 8) AS BIGINT)"


@register("cv_scores_univariate", f"""WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y, {_FOLD_SQL} % 5 AS fold FROM lineitem),
m AS (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t, (SELECT DISTINCT fold FROM t) f WHERE t.fold <> f.fold GROUP BY f.fold),
r AS (SELECT t.fold, 1 - sum((y - a - b * x) ^ 2) / (var_pop(y) * count(y)) AS r2 FROM t JOIN m ON t.fold = m.fold GROUP BY t.fold)
SELECT round(avg(r2), {R}) AS cv_mean, round(stddev_samp(r2), {R}) AS cv_std, CAST(count(*) AS INTEGER) AS folds FROM r""")
def q_cv_scores_univariate(spark, d):
    out = evaluate.cv_scores(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", ["l_orderkey", "l_linenumber"], k=5)
    return out.select(rnd("cv_mean"), rnd("cv_std"), "folds")


@register("score_holdout_univariate", f"""WITH t AS (SELECT *, {_FOLD_SQL} % 100 < 80 AS train FROM lineitem),
m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM t WHERE train)
SELECT l_orderkey, l_linenumber, l_quantity, round(a + b * l_quantity, {R}) AS predicted_l_extendedprice FROM t, m WHERE NOT train""")
def q_score_holdout_univariate(spark, d):
    train, hold = sampling.hash_split(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], 80)
    m = models.fit_ols(train, ["l_quantity"], "l_extendedprice")
    out = models.predict(m, hold, ["l_quantity"], "l_extendedprice", keep=["l_orderkey", "l_linenumber", "l_quantity"])
    return out.select("l_orderkey", "l_linenumber", "l_quantity", rnd("predicted_l_extendedprice"))


@register("logistic_gradient", """WITH t AS (SELECT lang, source FROM documents JOIN labels USING (doc_id))
SELECT 'n_chars' AS feature, CAST(0 AS DOUBLE) AS gradient UNION ALL SELECT '(intercept)', 0
UNION ALL SELECT 'lang_' || lang, 0 FROM (SELECT DISTINCT lang FROM t) WHERE lang > (SELECT min(lang) FROM t)
UNION ALL SELECT 'source_' || source, 0 FROM (SELECT DISTINCT source FROM t) WHERE source > (SELECT min(source) FROM t)""")
def q_logistic_gradient(spark, d):
    """M2: the summed-loss L2 objective has no slope left at the fitted coefficients."""
    data = _docs_labelled(spark, d)
    lf = features.fit_linear_features(data, ["n_chars", "lang", "source"])
    x = lf.transform(data, keep=["quality"]).persist()
    m = models.fit_logistic(x, lf.train_columns, "quality", C=1.0)
    coefs = dict(zip(lf.train_columns, m.coefficients.toArray().tolist()))
    margin = sum((F.col(f"`{c}`") * w for c, w in coefs.items()), F.lit(float(m.intercept)))
    miss = 1 / (1 + F.exp(-margin)) - F.col("quality")
    sums = x.agg(F.sum(miss).alias("g_"), *[F.sum(miss * F.col(f"`{c}`")).alias(f"g{i}") for i, c in enumerate(coefs)]).first()
    rows = [("(intercept)", float(sums["g_"]))] + [(c, float(sums[f"g{i}"]) + w) for i, (c, w) in enumerate(coefs.items())]
    return spark.createDataFrame([(c, abs(round(g, 2))) for c, g in rows], "feature string, gradient double")


@register("coefficient_extremes_by_type", f"""WITH b AS (SELECT avg(p_retailprice) AS base FROM part WHERE p_type = (SELECT min(p_type) FROM part)),
n AS (SELECT count(*) AS n FROM part)
SELECT 'p_type_' || p_type AS feature, round((avg(p_retailprice) - any_value(base)) * sqrt(count(*) / any_value(n) * (1 - count(*) / any_value(n))), 4) AS coefficient
FROM part, b, n WHERE p_type > (SELECT min(p_type) FROM part) GROUP BY p_type""")
def q_coefficient_extremes_by_type(spark, d):
    """O4 over one categorical feature, whose coefficients are differences of group means."""
    p = table(spark, d, "part")
    lf = features.fit_linear_features(p, ["p_type"])
    m = models.fit_ols(lf.transform(p, keep=["p_retailprice"]), lf.train_columns, "p_retailprice")
    out = explain.coefficient_extremes(models.coefficient_table(m, lf.train_columns), k=10)
    return out.select("feature", F.round("coefficient", 4).alias("coefficient"))


@register("sparse_dummies", """SELECT 'l_orderkey_' || l_orderkey AS feature, row_number() OVER (ORDER BY l_orderkey) - 1 AS entry,
  round(count(*) / (SELECT count(*) FROM lineitem), 8) AS mean, round(sqrt(count(*) / (SELECT count(*) FROM lineitem) * (1 - count(*) / (SELECT count(*) FROM lineitem))), 8) AS deviation
FROM lineitem GROUP BY l_orderkey QUALIFY row_number() OVER (ORDER BY l_orderkey) > 1
UNION ALL SELECT 'l_quantity', 0, round(avg(l_quantity), 8), round(stddev_pop(l_quantity), 8) FROM lineitem""")
def q_sparse_dummies(spark, d):
    """Every entry of the sparse layout, one for each order, with its mean and deviation."""
    state = sparse.fit_sparse_features(table(spark, d, "lineitem"), ["l_quantity", "l_orderkey"], ["l_orderkey"])
    out = state.entries(spark)
    return out.select("feature", "entry", F.round("mean", 8).alias("mean"), F.round("deviation", 8).alias("deviation"))


@register("linear_wide_categories", """SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER (PARTITION BY l_orderkey), 3) AS predicted_l_quantity FROM lineitem""")
def q_linear_wide_categories(spark, d):
    """L8 and M1 with a dummy for every order: least squares then predicts the mean of each order."""
    li = table(spark, d, "lineitem")
    model = sparse.fit_sparse_linear(li, ["l_orderkey"], "l_quantity", numeric_categoricals=["l_orderkey"])
    out = model.predict(li, ["l_orderkey", "l_linenumber"], "predicted_l_quantity")
    return out.withColumn("predicted_l_quantity", F.round("predicted_l_quantity", 3))


@register("multinomial_attribution", """SELECT o_orderkey, k AS class, CAST(0 AS DOUBLE) AS gap FROM orders, (SELECT unnest([0, 1, 2])::INTEGER AS k)""")
def q_multinomial_attribution(spark, d):
    """M11 with three classes: base value and contributions add up to the class's centred log-odds, as the fitted model's probabilities have them."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus")
    data = features.fit_label_encoder(o, ["o_orderstatus"]).transform(o)
    feats = ["o_totalprice", "o_custkey"]
    scaler = features.fit_scaler(data, feats)
    x = scaler.transform(data)
    m = models.fit_logistic(x, feats, "o_orderstatus")
    scored = m.transform(models.assemble(x, feats)).withColumn("p", vector_to_array("probability"))
    out = explain.multinomial_attribution(scored, m.coefficientMatrix.toArray(), m.interceptVector.toArray(), feats, {f: 0.0 for f in feats}, keep=["o_orderkey", "p"])
    total = sum((F.col(f"`{f}_contrib`") for f in feats), F.col("base_value"))
    logs = F.transform("p", lambda v: F.log(v))
    centred = F.element_at(logs, F.col("class") + 1) - F.aggregate(logs, F.lit(0.0), lambda a, v: a + v) / F.size(logs)
    return out.select("o_orderkey", "class", F.abs(F.round(total - centred, 6)).alias("gap"))


@register("pipeline_model_scores", f"""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a + b * l_quantity, {R}) AS predicted_l_extendedprice FROM lineitem, m""")
def q_pipeline_model_scores(spark, d):
    """Preparation and model saved as one pipeline, loaded again, score the raw table."""
    li = table(spark, d, "lineitem")
    path = scratch_path(spark, "pipeline-model")
    stages.save_pipeline(stages.linear_pipeline(["l_quantity"], "l_extendedprice").fit(li), path, {"target": "l_extendedprice"})
    model, notes = stages.load_pipeline(path)
    return model.transform(li).select("l_orderkey", "l_linenumber", rnd("prediction", f"predicted_{notes['target']}"))


@register("wide_category_order", f"""SELECT CAST(l_orderkey AS VARCHAR) AS value, count(*) AS n,
  round((sum(l_quantity) + 10 * (SELECT avg(l_quantity) FROM lineitem)) / (count(*) + 10), {R}) AS number FROM lineitem GROUP BY l_orderkey""")
def q_wide_category_order(spark, d):
    """M3: the order of a category with a value for every order, by the mean quantity."""
    state = models.fit_tree_features(table(spark, d, "lineitem"), ["l_orderkey"], ["l_orderkey"], label="l_quantity")
    order = state.ordered["l_orderkey"]
    number = (F.col("s") + models.ORDER_WEIGHT * order.mean) / (F.col("n") + models.ORDER_WEIGHT)
    return order.table.select("value", "n", F.round(number, R).alias("number"))


@register("gbt_wide_category", """SELECT l_orderkey, l_linenumber, true AS scored FROM lineitem""")
def q_gbt_wide_category(spark, d):
    """M3 with a category of a value for every order: every row is scored, inside the range of the target."""
    li = table(spark, d, "lineitem")
    feats = ["l_orderkey", "l_discount"]
    model, state = models.fit_gbt(li, feats, "l_quantity", "regression", {"n_estimators": 20, "max_depth": 5}, categoricals=["l_orderkey"])
    out = models.predict(model, li, feats, "l_quantity", keep=["l_orderkey", "l_linenumber"], tree_state=state)
    return out.select("l_orderkey", "l_linenumber", F.col("predicted_l_quantity").between(0, 60).alias("scored"))


@register("cv_gbt_scores", "SELECT CAST(5 AS INTEGER) AS folds, true AS beats_the_mean")
def q_cv_gbt_scores(spark, d):
    """M4 of the boosted model, at the form's defaults but for 20 trees of depth 4 (five fits)."""
    li = table(spark, d, "lineitem").withColumn("billed", F.col("l_extendedprice") + 10_000 * F.col("l_quantity"))
    out = evaluate.cv_gbt_scores(li, ["l_quantity", "l_discount", "l_returnflag"], "billed", ["l_orderkey", "l_linenumber"], params={"n_estimators": 20, "max_depth": 4})
    return out.select("folds", (F.col("cv_mean") > 0).alias("beats_the_mean"))


@register("score_and_export", f"""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, round(a + b * l_quantity, {R}) AS predicted_l_extendedprice FROM lineitem, m""")
def q_score_and_export(spark, d):
    """Every row scored, written as CSV by the executors and read back."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    path = scratch_path(spark, "scored")
    models.score_and_export(models.fit_ols(li, ["l_quantity"], "l_extendedprice"), li, ["l_quantity"], "l_extendedprice", path)
    out = files.read_csv(spark, path)
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", rnd("predicted_l_extendedprice"))


@register("numeric_categoricals", """SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, rank AS code FROM part
JOIN (SELECT p_size AS s, CAST(row_number() OVER (ORDER BY p_size) - 1 AS INTEGER) AS rank FROM (SELECT DISTINCT p_size FROM part)) ON p_size = s""")
def q_numeric_categoricals(spark, d):
    """L4: a numeric column marked as categorical gets its codes in the order of its values (2 before 10)."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    encoder = features.fit_label_encoder(p, ["p_size"])
    return encoder.transform(p, suffix="_code").withColumnRenamed("p_size_code", "code")


@register("present_mask", f"""SELECT l_orderkey, l_linenumber, l_linenumber % 4 <> 0 AS present FROM lineitem""")
def q_present_mask(spark, d):
    """which rows have a value (NULL and NaN are missing)."""
    nan = F.when(F.col("l_linenumber") % 8 == 0, F.lit(float("nan")))
    li = table(spark, d, "lineitem").withColumn("v", F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity")).otherwise(nan))
    return li.select("l_orderkey", "l_linenumber", features._present("v", li.schema["v"].dataType).isNotNull().alias("present"))


@register("importance_total", "SELECT CAST(1 AS DOUBLE) AS total, CAST(5 AS BIGINT) AS features")
def q_importance_total(spark, d):
    model, state = models.fit_gbt(table(spark, d, "lineitem"), _LI_FEATS, "l_extendedprice", "regression", categoricals=["l_returnflag"])
    return explain.feature_importance(model, state.columns()).agg(rnd(F.sum("importance"), "total"), F.count("feature").alias("features"))


@register("tree_attribution_sums", "SELECT l_orderkey, l_linenumber, CAST(0 AS DOUBLE) AS gap FROM lineitem")
def q_tree_attribution_sums(spark, d):
    """Base value and contributions add up to the prediction of every row."""
    li = table(spark, d, "lineitem")
    model, state = models.fit_gbt(li, _LI_FEATS, "l_extendedprice", "regression", categoricals=["l_returnflag"])
    keys = ["l_orderkey", "l_linenumber", "predicted_l_extendedprice"]
    scored = models.predict(model, li, _LI_FEATS, "l_extendedprice", keep=[*li.columns], tree_state=state)
    # features travel under their prepared form, so the two keys that are features too are renamed first
    named = scored.withColumnRenamed("l_linenumber", "line").withColumn("l_linenumber", F.col("line"))
    out = explain.tree_attribution(state.transform(named, keep=["l_orderkey", "line", "predicted_l_extendedprice"]), model, state.columns(), keep=["l_orderkey", "line", keys[2]])
    total = sum((F.col(f"`{c}`") for c in out.columns if c.endswith("_contrib")), F.col("base_value"))
    return out.select("l_orderkey", F.col("line").alias("l_linenumber"), F.abs(F.round(total - F.col(keys[2]), 4)).alias("gap"))
