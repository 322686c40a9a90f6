import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableprep.functions.stats import exact_quantiles, mode_of


def _pandas_q(values, p):
    s = pd.Series(values, dtype="float64").dropna()
    return None if s.empty else float(s.quantile(p))


@pytest.mark.parametrize("max_candidates", [100_000, 40, 5])
def test_exact_quantiles_match_pandas(spark, max_candidates):
    rng = np.random.default_rng(3)
    vals = list(rng.integers(0, 20, 300).astype(float)) + [float("nan"), None] + list(rng.normal(size=200))
    keys = ["a" if i % 3 else "b" for i in range(len(vals))]
    pdf = pd.DataFrame({"k": keys, "v": vals})
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in zip(keys, vals)], "k string, v double")
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {r["k"]: [r[f"q{i}"] for i in range(5)]
           for r in exact_quantiles(df, "v", probs, ["k"], max_candidates=max_candidates).collect()}
    for k, grp in pdf.groupby("k"):
        exp = [_pandas_q(grp["v"], p) for p in probs]
        assert np.allclose(got[k], exp), (k, got[k], exp)
    glob = exact_quantiles(df, "v", probs, max_candidates=max_candidates).collect()[0]
    assert np.allclose(list(glob), [_pandas_q(pdf["v"], p) for p in probs])


def test_exact_quantiles_hot_value_and_null_groups(spark):
    # one value holds a third of the rows; one group is all NULL
    data = [("x", 7.0)] * 400 + [("x", float(i)) for i in range(800)] + [("z", None)] * 3
    df = spark.createDataFrame(data, "k string, v double")
    out = {r["k"]: (r["q0"], r["q1"]) for r in exact_quantiles(df, "v", [0.5, 0.9], ["k"], max_candidates=10).collect()}
    s = pd.Series([v for k, v in data if k == "x"])
    assert out["x"] == pytest.approx((s.quantile(0.5), s.quantile(0.9)))
    assert out["z"] == (None, None)


def test_exact_quantiles_empty(spark):
    df = spark.createDataFrame([], "v double")
    assert list(exact_quantiles(df, "v", [0.5]).collect()[0]) == [None]


def test_mode_smallest_on_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string")
    assert mode_of(df, "c").collect()[0]["mode"] == "a"
    grouped = spark.createDataFrame([(1, 3), (1, 2), (1, 3), (2, 5)], "g int, v int")
    assert {r["g"]: r["mode"] for r in mode_of(grouped, "v", ["g"]).collect()} == {1: 3, 2: 5}


def test_exact_quantiles_state_over_byte_bound(spark, monkeypatch):
    """Per-group state wider than the byte bound is shuffle-joined, not
    broadcast; long text keys are measured, and the answer is unchanged."""
    from tableprep.functions import stats
    keys = ["k" * 300 + str(i % 4) for i in range(400)]
    vals = [float((i * 37) % 101) for i in range(400)]
    df = spark.createDataFrame(list(zip(keys, vals)), "k string, v double")
    n, size = stats._group_table_size(df.groupBy("k").count(), ["k"], 96)
    assert n == 4 and size >= 4 * 301
    monkeypatch.setattr(stats, "BROADCAST_GROUP_BYTES", 10)
    got = {r["k"]: (r["q0"], r["q1"]) for r in
           exact_quantiles(df, "v", [0.25, 0.5], ["k"], max_candidates=10).collect()}
    pdf = pd.DataFrame({"k": keys, "v": vals})
    for k, grp in pdf.groupby("k"):
        assert got[k] == pytest.approx((grp["v"].quantile(0.25), grp["v"].quantile(0.5)))


@pytest.mark.parametrize("limit, size", [(20, 64 << 20), (1000, 400), (1, 64 << 20), (3, 10)])
def test_exact_quantiles_of_many_groups_and_a_hot_one(spark, monkeypatch, limit, size):
    """Past the broadcast limits a group with a third of the rows is summed where its rows are; the answers stay."""
    from tableprep.functions import stats
    monkeypatch.setattr(stats, "BROADCAST_GROUP_LIMIT", limit)
    monkeypatch.setattr(stats, "BROADCAST_GROUP_BYTES", size)
    rows = [(None if i % 9 == 0 else "hot" if i % 3 == 0 else f"g{i % 211}", float((i * 7919) % 1013)) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    for most in (100_000, 50):
        got = {r["k"]: (r["q0"], r["q1"]) for r in exact_quantiles(df, "v", [0.5, 0.9], ["k"], max_candidates=most).collect()}
        want = {}
        for k, v in rows:
            want.setdefault(k, []).append(v)
        assert got == {k: pytest.approx((np.quantile(v, 0.5), np.quantile(v, 0.9))) for k, v in want.items()}


def test_hot_groups_stay_where_their_rows_are(spark, monkeypatch):
    from tableprep.functions import stats
    monkeypatch.setattr(stats, "BROADCAST_GROUP_LIMIT", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 60_000, 1, 8).selectExpr("IF(id % 3 = 0, -1, id) AS __k0", "id AS v")
        sizes = rows.groupBy("__k0").agg(F.count("*").alias("__n")).persist()
        meeting = stats.GroupJoin(sizes, ["__k0"], 100)
        assert meeting.hot == 60_000 // 50 and meeting.hot_keys.count() == 1
        joined = meeting.join(rows, sizes)
        assert joined.count() == 60_000 and joined.where("__k0 = -1").select("__n").distinct().collect() == [(20_000,)]
        per_task = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert max(per_task) < 2 * 60_000 / 16  # eight scan tasks and eight of the shuffle
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_groups_are_sorted_in_one_shuffle(spark, monkeypatch):
    """No sketch of a group that is sorted whole (one of 1,001 steps for every group took most of the time), and no joins of its own."""
    monkeypatch.setattr(F, "percentile_approx", None)
    df = spark.range(0, 3000, 1, 4).selectExpr("IF(id < 3, NULL, id % 1000) AS k", "IF(id % 1000 = 7, NULL, id * 1D) AS v")
    out = exact_quantiles(df, "v", [0.5, 0.9], ["k"], extra_aggs={"total": F.sum})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    want = df.toPandas().groupby("k", dropna=False)["v"]
    got = {r["k"]: (r["q0"], r["q1"], r["total"]) for r in out.collect()}
    assert len(got) == 1001 and got[7] == (None, None, None) and got[None] == pytest.approx((1, 1.8, 3))
    assert {k: q for k, q in got.items() if k not in (7, None)} == {
        int(k): pytest.approx((g.quantile(0.5), g.quantile(0.9), g.sum())) for k, g in want if k == k and k != 7}


def test_groups_of_many_missing_values_are_not_sorted_whole(spark):
    """A group is big by its rows, so one of many missing values goes the way of big groups."""
    df = spark.range(0, 900, 1, 4).selectExpr("CAST(id % 3 AS int) AS k", "IF(id % 3 = 0 AND id > 30 OR id % 3 = 1, NULL, id * 1D) AS v")
    got = {r["k"]: r["q0"] for r in exact_quantiles(df, "v", [0.5], ["k"], max_candidates=100).collect()}
    assert got == {0: 15.0, 1: None, 2: 450.5}


def test_quantiles_and_mode_of_odd_names(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (2, "b", 5.0)], "`k.1` int, `x y` string, `v.w` double")
    assert {tuple(r) for r in exact_quantiles(df, "v.w", [0.5], ["k.1", "x y"], names=["m.d"]).collect()} == {(1, "a", 3.0), (2, "b", 5.0)}
    assert {tuple(r) for r in mode_of(df, "v.w", ["k.1"]).collect()} == {(1, 2.0), (2, 5.0)}
