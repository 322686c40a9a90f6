import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions import casts
from tableprep.operators import clean

from .conftest import rows


def test_impute_strategies_in_order(spark):
    df = spark.createDataFrame([(1, 10.0, "a", 3), (2, None, None, None), (3, 30.0, "b", 5), (4, None, "b", 6)],
                               "id int, x double, s string, n int")
    out = clean.impute(df, [("x", "mean"), ("s", "mode"), ("n", "zero")])
    assert rows(out) == [(1, 10.0, "a", 3), (2, 20.0, "b", 0), (3, 30.0, "b", 5), (4, 20.0, "b", 6)]
    # drop first changes the later statistic
    out = clean.impute(df, [("s", "drop"), ("x", "mean")])
    assert rows(out, "id", "x") == [(1, 10.0), (3, 30.0), (4, 20.0)]


def test_impute_mean_on_int_becomes_double_and_guards(spark):
    df = spark.createDataFrame([(1, "p"), (None, None), (2, "q")], "n int, s string")
    out = clean.impute(df, [("n", "mean"), ("s", "mean")])  # mean is a no-op on text
    assert dict(out.dtypes)["n"] == "double"
    assert rows(out, "n") == [(1.0,), (1.5,), (2.0,)]
    assert (None,) in rows(out, "s")


def test_mode_unknown_and_median(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), (None, 4.0), (None, 10.0)], "s string, v double")
    out = clean.impute(df, [("s", "mode"), ("v", "median")])
    assert set(r[0] for r in out.select("s").collect()) == {"Unknown"}
    assert sorted(r[0] for r in out.select("v").collect()) == [1.0, 4.0, 4.0, 10.0]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,)], "v double")
    assert rows(clean.impute(df, [("v", "zero")])) == [(0.0,), (2.0,)]
    assert clean.drop_missing(df, ["v"]).count() == 1


def test_forward_fill_needs_order(spark):
    df = spark.createDataFrame([(1, None)], "t int, v double")
    with pytest.raises(ValueError):
        clean.impute(df, [("v", "forward")])


def test_dedupe(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1), (4, "a", None)], "id int, k string, v int")
    assert clean.dedupe(df.drop("id")).count() == 2  # NULLs compare equal
    kept = clean.dedupe(df, ["k", "v"], order_by=["id"])
    assert rows(kept) == [(1, "a", None), (3, "b", 1)]
    _, removed = clean.dedupe_with_count(df.drop("id"))
    assert removed == 2


def test_to_int_fraction_modes(spark):
    df = spark.createDataFrame([("5",), ("5.0",), ("5.7",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(casts.to_int("s", T.StringType(), "null")).collect()] == [5, 5, None, None, None]
    assert [r[0] for r in df.select(casts.to_int("s", T.StringType(), "truncate")).collect()] == [5, 5, 5, None, None]
    with pytest.raises(Exception):
        df.select(casts.to_int("s", T.StringType(), "error")).collect()


def test_to_float_and_string(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("abc",), (None,)], "s string")
    assert [r[0] for r in df.select(casts.to_float("s")).collect()] == [1.5, None, None, None]
    df2 = spark.createDataFrame([(1.0,), (None,)], "d double")
    assert [r[0] for r in df2.select(casts.to_string("d")).collect()] == ["1.0", None]
    assert [r[0] for r in df2.select(casts.to_string("d", null_token="nan")).collect()] == ["1.0", "nan"]


def test_to_date(spark):
    df = spark.createDataFrame([("2024/01/02",), ("2024-13-01",), ("2024-03-04 05:06:07",), ("nope",)], "s string")
    assert [r[0] for r in df.select(casts.to_date("s")).collect()] == [
        dt.date(2024, 1, 2), None, dt.date(2024, 3, 4), None]
    ints = spark.createDataFrame([(1,), (86_400 * 10 ** 9,)], "i long")
    assert [r[0] for r in ints.select(casts.to_date("i", T.LongType())).collect()] == [
        dt.date(1970, 1, 1), dt.date(1970, 1, 2)]


def test_coerce_default(spark):
    df = spark.createDataFrame([("3",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(casts.coerce_default("s", -1)).collect()] == [3.0, -1.0, -1.0]
    assert [r[0] for r in df.select(casts.coerce_default("s", 0, "bigint")).collect()] == [3, 0, 0]


def test_mode_of_dates_and_booleans(spark):
    import datetime as dt2
    df = spark.createDataFrame([(dt2.date(2024, 1, 2), True), (dt2.date(2024, 1, 2), None), (None, True),
                                (dt2.date(2023, 5, 5), False)], "d date, b boolean")
    out = clean.impute(df, [("d", "mode"), ("b", "mode")]).collect()
    assert {r["d"] for r in out} == {dt2.date(2024, 1, 2), dt2.date(2023, 5, 5)}
    assert [r["b"] for r in out].count(True) == 3


def test_text_that_only_looks_like_a_number(spark):
    from tableprep.functions import casts
    df = spark.createDataFrame([("10D",), ("1f",), ("0x1p3",), ("5.7",), (" 12 ",), ("1e3",), ("inf",)], "v string")
    got = df.select(casts.to_float("v").alias("f"), casts.to_int("v", None, "null").alias("i"), casts.coerce_default("v", -1).alias("d")).collect()
    assert [r.f for r in got] == [None, None, None, 5.7, 12.0, 1000.0, float("inf")]
    assert [r.i for r in got][:6] == [None, None, None, None, 12, 1000]
    assert [r.d for r in got][:5] == [-1.0, -1.0, -1.0, 5.7, 12.0]


def test_decimal_fraction_is_no_integer(spark):
    from tableprep.functions import casts
    df = spark.sql("SELECT CAST(5.7 AS DECIMAL(10,2)) AS a, CAST(5 AS DECIMAL(10,2)) AS b")
    dt = df.schema["a"].dataType
    assert tuple(df.select(casts.to_int("a", dt, "null").alias("x"), casts.to_int("a", dt, "truncate").alias("y"), casts.to_int("b", dt).alias("z")).first()) == (None, 5, 5)
    with pytest.raises(Exception, match="fractional"):
        df.select(casts.to_int("a", dt)).collect()


def test_dates_in_many_forms(spark):
    import datetime as dt

    from tableprep.functions import casts
    df = spark.createDataFrame([(t,) for t in ("2024-1-5", "Jan 5, 2024", "5 January 2024", "2024-01-05T10:00:00Z", "2024/1/5", "13/45/2024")], "d string")
    assert [r[0] for r in df.select(casts.to_date("d")).collect()] == [dt.date(2024, 1, 5)] * 5 + [None]


def test_nan_is_filled_and_names_may_hold_dots(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, nan, nan), (3, None, 7.0)], ["i", "a.1", "x y"])
    out = clean.impute(df, [("a.1", "forward"), ("x y", "forward")], order_by=["i"]).orderBy("i").collect()
    assert [tuple(r) for r in out] == [(1, 1.0, 5.0), (2, 1.0, 5.0), (3, 1.0, 7.0)]
    assert clean.fit_medians(df, ["x y"]) == {"x y": 6.0}


def test_mode_fill_keeps_decimals(spark):
    df = spark.sql("SELECT CAST(x AS DECIMAL(6,2)) AS v FROM VALUES (1.10), (1.10), (2.00), (NULL) AS t(x)")
    out = clean.fill_mode(df, ["v"])
    assert out.dtypes == [("v", "decimal(6,2)")] and sorted(str(r.v) for r in out.collect()) == ["1.10", "1.10", "1.10", "2.00"]
