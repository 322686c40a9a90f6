import pytest
from pyspark.sql import functions as F

from tableprep.ml import features, models
from tableprep.plans.prep import PrepPlan
from tableprep.streaming import check_stream_safe, prep_stream, score_stream

from .conftest import SF001


def test_refuses_whole_table_stages():
    with pytest.raises(ValueError):
        check_stream_safe(PrepPlan(index="yes"))
    with pytest.raises(ValueError):
        check_stream_safe(PrepPlan(missing=(("x", "median"),)))
    check_stream_safe(PrepPlan(missing=(("x", "median"),)), {"x": 1.0})


def test_stream_prep_and_score(spark, tmp_path):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_discount",
                                                                 "l_extendedprice", "l_returnflag")
    src = str(tmp_path / "in")
    li.limit(500).write.parquet(src)
    lf = features.fit_linear_features(li, ["l_quantity", "l_discount", "l_returnflag"])
    x = lf.transform(li, keep=["l_extendedprice"])
    m = models.fit_ols(x, lf.train_columns, "l_extendedprice")

    stream = spark.readStream.schema(li.schema).parquet(src)
    prepped = prep_stream(stream, PrepPlan(missing=(("l_discount", "zero"),), filter="l_quantity > 10"))
    scored = score_stream(prepped, m, [], "l_extendedprice", keep=["l_orderkey"], feature_state=lf)
    q = scored.writeStream.format("memory").queryName("scored_stream").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("scored_stream")
    batch = spark.read.parquet(src).where("l_quantity > 10")
    assert got.count() == batch.count()
    assert got.columns == ["l_orderkey", "predicted_l_extendedprice"]


def test_dictionary_label_encoder_on_stream(spark, tmp_path):
    """The wide-column encoder is a stream-static left join: a stream gets
    the same codes as the batch table."""
    o = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey", "o_custkey")
    enc = features.fit_label_encoder(o, ["o_custkey"], literal_limit=10)
    assert set(enc.dictionaries) == {"o_custkey"}
    src = str(tmp_path / "orders")
    o.write.parquet(src)
    stream = spark.readStream.schema(o.schema).parquet(src)
    q = enc.transform(stream).writeStream.format("memory").queryName("encoded_stream").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("encoded_stream").collect()) == sorted(enc.transform(o).collect())
