"""Load plan (S1, S2, S5, P10), date layouts (C4), boundaries with long keys."""

import datetime

import pytest
from pyspark.sql import functions as F

from tableprep.functions import casts
from tableprep.operators import order
from tableprep.plans import load
from tableprep.plans.prep import PrepPlan, apply_plan
from tableprep.sources import files


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


@pytest.mark.parametrize("first, label", [("0,1,2,3", "id"), ("1,1,2,9", "id"), ("2,3,4,5", None), ("1,3,2,4", None), ("a,b,c,d", None), ("1,,2,3", None), ("0.0,0.5,2,3", "id")])
def test_sequential_first_column_becomes_the_label(spark, tmp_path, first, label):
    path = write(tmp_path, "t.csv", "id,v\n" + "".join(f"{x},{i}\n" for i, x in enumerate(first.split(","))))
    df = load.load_table(spark, path)
    assert load.label_of(df) == label and load.label_of(load.load_table(spark, path, auto_index=False)) is None
    assert load.feature_names(df) == (["v"] if label else ["id", "v"])
    later = df.where("v >= 0").select("v", "id").orderBy("v")
    assert load.label_of(later) == label
    plain = load.label_to_column(later, "row")
    assert load.label_of(plain) is None and plain.columns == (["row", "v"] if label else ["v", "id"])


def test_sequences_over_many_files_and_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        spark.range(0, 3000, 1, 5).write.csv(f"{tmp_path}/up", header=True)
        assert load.label_of(load.load_table(spark, f"{tmp_path}/up")) == "id"
        # in order inside every file, but not from one file to the next
        spark.range(0, 3000, 1, 1).repartition(3, F.col("id") % 3).sortWithinPartitions("id").write.csv(f"{tmp_path}/mixed", header=True)
        assert load.label_of(load.load_table(spark, f"{tmp_path}/mixed")) is None
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_blank_lead_column_is_replaced_by_numbers(spark, tmp_path):
    df = load.load_table(spark, write(tmp_path, "b.csv", ",a,b\n,5,x\n,7,y\n,6,z\n"))
    assert [tuple(r) for r in df.orderBy("Index").collect()] == [(1, 5, "x"), (2, 7, "y"), (3, 6, "z")]
    assert load.label_of(df) == "Index" and load.feature_names(df, "b") == ["a"]


def test_an_empty_extra_field_is_an_extra_field(spark, tmp_path):
    with pytest.raises(Exception, match="more than 2 fields"):
        files.read_csv(spark, write(tmp_path, "e.csv", "a,b\n1,2\n3,4,\n")).collect()
    df = files.read_csv(spark, write(tmp_path, "q.csv", 'a,b\n1,"x,y"\n3\n"4,5",\n'))
    assert sorted(map(tuple, df.collect()), key=str) == [("1", "x,y"), ("3", None), ("4,5", None)]


def test_a_column_has_one_order_of_day_and_month(spark):
    rows = [("13/05/2024", "05/13/2024", "01/02/2024", "2024-01-02", "13/05/2024"), ("01/02/2024", "01/02/2024", "03/04/2024", "3/4/2024", "25/12/2024"),
            ("bad", None, "", "20240506", "12/25/2024"), ("7-8-2024", "7-8-2024", "1-2-2024", "7 May 2024", "01/02/2024")]
    df = spark.createDataFrame(rows, "`day.first` string, month string, either string, iso string, mixed string")
    formats = casts.date_formats(df, df.columns)
    out = df.select(*[casts.to_date(F.col(f"`{c}`"), None, formats[c]).alias(c) for c in df.columns]).collect()
    d = datetime.date
    assert [r["day.first"] for r in out] == [d(2024, 5, 13), d(2024, 2, 1), None, d(2024, 8, 7)]
    assert [r["month"] for r in out] == [d(2024, 5, 13), d(2024, 1, 2), None, d(2024, 7, 8)]
    assert [r["either"] for r in out] == [d(2024, 1, 2), d(2024, 3, 4), None, d(2024, 1, 2)]  # nothing decides: month first
    assert [r["iso"] for r in out] == [d(2024, 1, 2), d(2024, 3, 4), d(2024, 5, 6), d(2024, 5, 7)]
    assert [r["mixed"] for r in out] == [d(2024, 5, 13), d(2024, 12, 25), None, d(2024, 2, 1)]  # two to one for day first
    counted = {(r["layout"], r["day_first"]): (r["parsed"], r["present"]) for r in casts.date_layouts(df, ["mixed"]).collect()}
    assert counted["d/M/yyyy", True] == (3, 4) and counted["M/d/yyyy", False] == (2, 4)
    planned = apply_plan(df, PrepPlan(casts=(("mixed", "datetime"),))).select("mixed").collect()
    assert [r[0] for r in planned] == [r["mixed"] for r in out]


@pytest.mark.parametrize("window", [20_000, 0])
def test_boundaries_of_long_text_keys_stay_small(spark, monkeypatch, window):
    """Keys of a megabyte: numbering stays exact, boundaries are cut, and no task sorts the whole sample."""
    monkeypatch.setattr(order, "WINDOW_SAMPLE", window)
    df = spark.range(120).select(F.concat(F.lpad(((F.col("id") * 37) % 120).cast("string"), 3, "0"), F.repeat(F.lit("x"), 1 << 20)).alias("k"), "id")
    bk = order.range_buckets(df, ["k"], None, 12)
    bounds = bk.bounds_df.first()["b"]
    assert 8 <= len(bounds) <= 13 and max(len(b["f0"]) for b in bounds) <= order.BOUNDARY_CHARS
    got = order.add_row_index(df, ["k"], n_buckets=12).select("Index", "id").collect()
    assert sorted((r["Index"], r["id"]) for r in got) == sorted((((i * 37) % 120) + 1, i) for i in range(120))
    # all keys alike in their first characters share a bucket, and are numbered right all the same
    same = spark.range(60).select(F.concat(F.repeat(F.lit("y"), 5000), F.lpad(((F.col("id") * 7) % 60).cast("string"), 2, "0")).alias("k"), "id")
    got = order.add_row_index(same, ["k"], n_buckets=6).select("Index", "id").collect()
    assert sorted((r["Index"], r["id"]) for r in got) == sorted((((i * 7) % 60) + 1, i) for i in range(60))


def test_every_kth_key_is_the_kth(spark):
    sample = spark.range(5000).select(F.struct(((F.col("id") * 1237) % 5000).alias("f0"), F.lit(0).alias("h")).alias("__t")).repartition(7)
    assert [r["__t"]["f0"] for r in order._every_kth(sample, 100).collect()] == list(range(99, 5000, 100))
