import pytest
from pyspark.sql import functions as F

from tableprep.operators import profile, reshape, sampling
from tableprep.plans.prep import PrepPlan, apply_plan

from .conftest import rows


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(
        [("a", "x", 1.0), ("a", "y", None), ("b", "x", 3.0), ("b", "x", 5.0), (None, "x", 9.0), ("c", "y", None)],
        "k string, c string, v double")


def test_group_rules(sales):
    s = {r[0]: r[1] for r in reshape.group_aggregate(sales, "k", "v", "sum").collect()}
    assert s == {"a": 1.0, "b": 8.0, "c": 0.0}  # all-missing group sums to 0, NULL key dropped
    sd = {r[0]: r[1] for r in reshape.group_aggregate(sales, "k", "v", "std").collect()}
    assert sd["a"] is None and sd["b"] == pytest.approx(2 ** 0.5)
    med = {r[0]: r[1] for r in reshape.group_aggregate(sales, "k", "v", "median").collect()}
    assert med == {"a": 1.0, "b": 4.0, "c": None}
    assert reshape.group_aggregate(sales, "k", "v", "count").columns == ["k", "v_count"]
    with pytest.raises(ValueError):
        reshape.group_aggregate(sales, "k", "c", "mean")


def test_pivot_null_rules(sales):
    piv = reshape.pivot_table(sales, "k", "c", "v", "mean")
    # index c and column y hold no value at all: both vanish
    assert piv.columns == ["k", "x"]
    assert {r["k"]: r["x"] for r in piv.collect()} == {"a": 1.0, "b": 4.0}
    cnt = {r["k"]: (r["x"], r["y"]) for r in reshape.pivot_table(sales, "k", "c", "v", "count").collect()}
    assert cnt == {"a": (1, 0), "b": (2, None), "c": (None, 0)}
    sm = {r["k"]: (r["x"], r["y"]) for r in reshape.pivot_table(sales, "k", "c", "v", "sum").collect()}
    assert sm == {"a": (1.0, 0.0), "b": (8.0, None), "c": (None, 0.0)}


def test_pivot_long_form_and_width_guard(sales):
    long = {(r["k"], r["c"]): r["__cell"] for r in reshape.pivot_cells(sales, "k", "c", "v", "count").collect()}
    assert long == {("a", "x"): 1, ("a", "y"): 0, ("b", "x"): 2, ("c", "y"): 0}
    with pytest.raises(ValueError, match="pivot_cells"):
        reshape.pivot_table(sales, "k", "c", "v", "count", max_values=1)


def test_filter_sort_head(sales):
    assert reshape.filter_rows(sales, "  ").count() == 6
    assert reshape.filter_rows(sales, "v > 2").count() == 3
    assert reshape.filter_rows(sales, "nonsense >>> 1", on_error="skip").count() == 6
    with pytest.raises(Exception):
        reshape.filter_rows(sales, "no_such_col > 1")
    ordered = [r["v"] for r in reshape.sort_rows(sales, "v", ascending=False).collect()]
    assert ordered[:4] == [9.0, 5.0, 3.0, 1.0] and ordered[4:] == [None, None]
    assert reshape.sort_rows(sales, "missing").count() == 6
    assert [r["v"] for r in reshape.head_rows(sales, 2, ["v"]).collect()] == [1.0, 3.0]


def test_sorted_partitions_follow_rows_not_packed_bytes(spark, monkeypatch):
    """Rows that repeat pack to almost nothing and were merged into few tasks; equal rows all met in one."""
    monkeypatch.setattr(reshape, "SORT_PART_BYTES", 100_000, raising=False)
    df = spark.range(0, 20_000, 1, 8).selectExpr("id % 4 AS v", "'x' AS `t.1`", "IF(id % 4 = 1, NULL, 1.5D) AS w")
    for ascending in (True, False):
        out = reshape.sort_rows(df, "v", ascending)
        got = out.collect()
        assert out.columns == df.columns and [r["v"] for r in got] == sorted((i % 4 for i in range(20_000)), reverse=not ascending)
        assert all((r["w"] is None) == (r["v"] == 1) and r["t.1"] == "x" for r in got)
        assert max(r[1] for r in out.groupBy(F.spark_partition_id()).agg(F.count("w")).collect()) <= 2_000
    assert [r["v"] for r in reshape.sort_rows(df, "v", False, first=3).collect()] == [3, 3, 3]
    assert reshape.sort_rows(df.where("v > 9"), "v").count() == 0


def test_projections(spark):
    df = spark.createDataFrame([(1, "F", 2.0)], "id int, s string, q double")
    assert reshape.drop_first_column(df).columns == ["s", "q"]
    assert reshape.map_labels(df, "s", {"F": "done"}, "lbl").collect()[0]["lbl"] == "done"
    assert reshape.with_derived(df, "z", "q * 2").collect()[0]["z"] == 4.0


def test_profile(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, "a"), (3, float("nan"), None), (4, 6.0, "b")],
                               "i long, d double, s string")
    miss = {r["column"]: (r["missing"], r["missing_pct"]) for r in profile.missing_report(df).collect()}
    assert miss == {"i": (0, 0.0), "d": (2, 50.0), "s": (1, 25.0)}
    desc = {r["column"]: r for r in profile.describe_numeric(df).collect()}
    assert desc["d"]["count"] == 2 and desc["d"]["q50"] == 4.0 and desc["i"]["q25"] == 1.75
    num, cat = profile.column_stats(df)
    assert {r["column"]: r["unique_count"] for r in cat.collect()} == {"s": 2}
    dc = {r["column"]: r["unique_count"] for r in profile.distinct_counts(df).collect()}
    assert dc == {"i": 4, "d": 2, "s": 2}
    prof = {r["column"]: r for r in profile.profile_table(df).collect()}
    assert prof["s"]["kind"] == "categorical" and prof["i"]["rows"] == 4
    assert profile.validate_dataset(df, min_rows=4) and not profile.validate_dataset(df, min_rows=5)


def test_splits_partition_rows(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 3).cast("int"))
    tr, ho = sampling.hash_split(df, ["id"], 80)
    assert tr.count() + ho.count() == 1000 and tr.join(ho, "id").count() == 0
    st, sh = sampling.stratified_split(df, "label", ["id"], 0.8)
    sizes = {r["label"]: r["count"] for r in st.groupBy("label").count().collect()}
    full = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    import math
    assert all(sizes[k] == n - math.ceil(0.2 * n) for k, n in full.items())
    folds = sampling.assign_folds(df, ["id"], 5)
    assert set(r[0] for r in folds.select("fold").distinct().collect()) == set(range(5))
    assert sampling.sample_n(df, 7, ["id"]).count() == 7


def test_prep_plan_stage_order(spark):
    # index first (gaps remain after the drop), then drop, then group
    df = spark.createDataFrame([(10, 1.0, "a"), (11, None, "a"), (12, 3.0, "b")], "id long, v double, g string")
    plan = PrepPlan(index="yes", index_order_by=("id",), missing=(("v", "drop"),))
    out = apply_plan(df, plan)
    assert rows(out, "Index", "id") == [(1, 10), (3, 12)]
    grouped = apply_plan(df, PrepPlan(missing=(("v", "zero"),), group=("g", "v", "sum"), sort_column="v"))
    assert rows(grouped) == [("a", 1.0), ("b", 3.0)]
    skipped = apply_plan(df, PrepPlan(group=("g", "nope", "sum"), on_error="skip"))
    assert skipped.count() == 3


def test_large_sample_equals_top_k(spark):
    from tableprep.operators import sampling as S
    df = spark.range(3000).withColumn("v", F.col("id") % 7)
    small = S.sample_n(df, 1200, ["id"])
    old = S.TOP_K_LIMIT
    try:
        S.TOP_K_LIMIT = 10
        big = S.sample_n(df, 1200, ["id"])
    finally:
        S.TOP_K_LIMIT = old
    assert sorted(r[0] for r in small.select("id").collect()) == sorted(r[0] for r in big.select("id").collect())


def test_sample_threshold_cut_equals_top_k(spark, monkeypatch):
    """Many partitions: the hash-threshold cut keeps exactly the top-k rows,
    also when one key (one hash) holds a third of the rows."""
    from tableprep.operators import sampling as S
    df = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")))
    df = df.repartition(12)
    for n in (1, 50, 1200):
        want = sorted(tuple(r) for r in df.orderBy(S.hash_hex(["k"]), "k").limit(n).select("k").collect())
        monkeypatch.setattr(S, "TOP_K_MERGE_ROWS", 10)
        got = sorted(tuple(r) for r in S.sample_n(df, n, ["k"]).select("k").collect())
        monkeypatch.setattr(S, "TOP_K_MERGE_ROWS", 2_000_000)
        assert len(got) == n and got == want, n


def test_sample_branches_keep_equal_rows_of_repeated_keys(spark, monkeypatch):
    from tableprep.operators import sampling as S
    df = spark.range(3000).withColumn("k", F.col("id") % 4).repartition(12)
    top = rows(S.sample_n(df, 1000, ["k"]))
    monkeypatch.setattr(S, "TOP_K_LIMIT", 10)
    assert len(top) == 1000 and rows(S.sample_n(df, 1000, ["k"])) == top


def test_dedupe_subset_is_deterministic(spark):
    from tableprep.operators import clean as C
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "k string, v int").repartition(3)
    assert sorted(tuple(r) for r in C.dedupe(df, ["k"]).collect()) == [("a", 1), ("b", 2)]
