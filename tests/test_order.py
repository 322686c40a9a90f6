import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableprep.operators.order import add_row_index, fill_ordered, rank_within, sequential_index_report

from .conftest import SF001


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_row_index_dense_and_ordered(spark, parts):
    o = spark.read.parquet(f"{SF001}/orders.parquet").repartition(parts)
    got = add_row_index(o, ["o_totalprice", "o_orderkey"], n_buckets=7).select("Index", "o_totalprice", "o_orderkey").toPandas()
    got = got.sort_values("Index")
    assert list(got["Index"]) == list(range(1, len(got) + 1))
    exp = got.sort_values(["o_totalprice", "o_orderkey"])
    assert list(exp["o_orderkey"]) == list(got["o_orderkey"])


def test_row_index_ties_and_duplicates(spark):
    # many equal keys and fully identical rows: numbering is still dense
    data = [(1, "x")] * 50 + [(0, "y")] * 5 + [(2, "x"), (1, "w")]
    df = spark.createDataFrame(data, "k int, s string")
    got = add_row_index(df, ["k"], n_buckets=6).toPandas().sort_values("Index")
    assert list(got["Index"]) == list(range(1, 58))
    assert list(got["k"]) == sorted(k for k, _ in data)


def test_row_index_refuses_existing(spark):
    df = spark.createDataFrame([(1,)], "Index int")
    with pytest.raises(ValueError):
        add_row_index(df, ["Index"])


def test_file_order_index(spark, tmp_path):
    pdf = pd.DataFrame({"a": [5, 3, 9, 1, 7] * 40, "b": list("abcde") * 40})
    path = str(tmp_path / "t.csv")
    pdf.to_csv(path, index=False)
    df = spark.read.option("header", True).option("maxPartitionBytes", 200).csv(path)
    got = add_row_index(df).toPandas().sort_values("Index")
    assert list(got["Index"]) == list(range(1, 201))
    assert list(got["a"].astype(int)) == list(pdf["a"])


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("keyed", [False, True])
def test_fill_matches_pandas(spark, direction, keyed):
    rng = np.random.default_rng(1)
    n = 400
    pdf = pd.DataFrame({"t": np.arange(n), "k": rng.integers(0, 4, n),
                        "v": np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n))})
    pdf.loc[0:5, "v"] = np.nan  # leading gap stays NULL forward
    df = spark.createDataFrame([(int(t), int(k), None if np.isnan(v) else float(v)) for t, k, v in pdf.itertuples(index=False)],
                               "t long, k long, v double").repartition(5)
    out = fill_ordered(df, ["v"], ["t"], direction, ["k"] if keyed else [], n_buckets=9).toPandas().sort_values("t")
    s = pdf.groupby("k")["v"] if keyed else pdf["v"]
    exp = s.ffill() if direction == "forward" else s.bfill()
    assert np.allclose(out["v"].to_numpy(dtype=float), exp.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_fill_text_column_matches_pandas(spark, direction):
    """Text values are variable-width: the carry table is not hinted to
    broadcast (AQE decides); the fill must still equal pandas."""
    rng = np.random.default_rng(4)
    n = 300
    vals = [None if rng.random() < 0.5 else "x" * int(rng.integers(1, 50)) + str(i) for i in range(n)]
    vals[0] = vals[-1] = None
    pdf = pd.DataFrame({"t": np.arange(n), "s": vals})
    df = spark.createDataFrame([(int(t), s) for t, s in pdf.itertuples(index=False)], "t long, s string").repartition(4)
    out = fill_ordered(df, ["s"], ["t"], direction, n_buckets=7)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()
    got = out.toPandas().sort_values("t")["s"].tolist()
    exp = (pdf["s"].ffill() if direction == "forward" else pdf["s"].bfill()).tolist()
    assert [None if isinstance(v, float) else v for v in exp] == got


def test_rank_within_and_sizes(spark):
    data = [("a", i) for i in range(30)] + [("b", i) for i in range(3)]
    df = spark.createDataFrame(data, "g string, x int")
    got = rank_within(df, ["g"], ["x"], size_name="n", n_buckets=5).toPandas()
    for g, grp in got.groupby("g"):
        assert list(grp.sort_values("x")["rank"]) == list(range(1, len(grp) + 1))
        assert set(grp["n"]) == {len(grp)}


def test_sequential_report(spark):
    df = spark.createDataFrame([(i, 10 - i, "s") for i in range(1, 11)], "i long, j long, s string")
    rep = {r["column"]: r for r in sequential_index_report(df, ["i", "j", "s"], ["i"], n_buckets=3).collect()}
    assert rep["i"]["is_index"] and rep["i"]["first_value"] == 1.0
    assert not rep["j"]["is_monotonic"]
    assert not rep["s"]["is_index"]


def test_hot_key_is_spread_and_exact(spark):
    # one key holds a third of the rows: buckets split it, tasks stay balanced
    from tableprep.operators.order import lead_columns, range_buckets
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    sk = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    bk = range_buckets(sk, lead_columns(sk, ["event_id"], ["user_id"]))
    sizes = [r[0] for r in bk.apply(sk).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) / (sum(sizes) / len(sizes)) < 1.6
    m = sk.withColumn("value", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value"))).select(
        "event_id", "user_id", "value")
    out = fill_ordered(m, ["value"], ["event_id"], "forward", ["user_id"]).toPandas().sort_values("event_id")
    pdf = m.toPandas().sort_values("event_id")
    assert np.allclose(out["value"].to_numpy(dtype=float), pdf.groupby("user_id")["value"].ffill().to_numpy(),
                       equal_nan=True)


@pytest.mark.parametrize("keyed", [False, True])
def test_backward_fill_runs_over_a_bucket_once(spark, keyed):
    """a frame from the row to the end of its bucket costs the square of the bucket's rows."""
    df = spark.range(300).selectExpr("id AS t", "id % 3 AS k", "IF(id % 4 = 0, CAST(id AS double), NULL) AS v")
    out = fill_ordered(df, ["v"], ["t"], "backward", ["k"] if keyed else [], n_buckets=4)
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    want = {t: (min((u for u in range(t, 300) if u % 4 == 0 and (not keyed or u % 3 == t % 3)), default=None)) for t in range(300)}
    assert {r["t"]: r["v"] for r in out.collect()} == want
