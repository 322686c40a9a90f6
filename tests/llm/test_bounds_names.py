"""Bounds of the training sets, clashing column names, repeated rows in every operator and stage."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tableprep.llm import _common as C
from tableprep.llm import chat_format, fill_middle, mixing, packing, quality, quality_rules, secrets, simhash, suffix_dedup, toxicity, trees

from ..conftest import SF001

# every name that a module gives to a column of its own on the way
NAMES = """d h h__ k k_ position epoch copy copies row size bucket b s first base inside goal target taken weight cap room rest level th n twin score predicted held_out kept label
y x turn slots fp root node least component_id kept_id kept_hash text_hash met__ spans runs path start length value before after assigned quoted at of piece row_hash rank
sequence_id offset ids part seq crc n_tokens h0 h1 h2 h3 output form prefix_chars middle_chars again tie chars long_id payload view front mask pattern members""".split()


@pytest.fixture(scope="module")
def crowded(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("doc_id < 150")
    return docs, docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)])


def rows(df, columns=None):
    return sorted(map(str, df.select(*(columns or df.columns)).collect()))


@pytest.mark.parametrize("name, operate", [
    ("op1", lambda d, lb: secrets.scan(d)),
    ("op3", lambda d, lb: quality.classify(d, lb)),
    ("op4", lambda d, lb: suffix_dedup.dedup(d)),
    ("op5", lambda d, lb: packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32")),
    ("op7", lambda d, lb: simhash.near_duplicates(d)),
    ("op8", lambda d, lb: mixing.mix_plan(d)),
    ("op9", lambda d, lb: quality_rules.judge(d, lb)),
    ("op10", lambda d, lb: toxicity.classify(d, lb)),
    ("op11", lambda d, lb: fill_middle.transform_documents(d)),
])
def test_operators_ignore_clashing_names(spark, crowded, name, operate):
    plain, wide = crowded
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    assert rows(operate(wide, labels.select("*", *[F.lit(0).alias(c) for c in NAMES]))) == rows(operate(plain, labels))


@pytest.mark.parametrize("at", range(5))
def test_stages_keep_clashing_columns(spark, crowded, at):
    plain, wide = crowded
    name, stage = corpus_pipeline.STAGES[at]
    a, b = stage(spark, plain, SF001), stage(spark, wide, SF001)
    if name == "packing":
        columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
        assert rows(a, columns) == rows(b, columns)
        return
    assert b.columns == wide.columns
    assert rows(a) == rows(b, plain.columns)
    assert b.select(*NAMES).distinct().collect() == [tuple(range(len(NAMES)))]


def test_mix_keeps_a_position_of_the_table(spark, crowded):
    out = mixing.mix_documents(crowded[1])
    assert out.columns[-2:] == ["position_", "epoch_"] and out.select("position").distinct().count() == 1


def test_one_labelled_id_in_many_rows_does_not_pass_the_bound(spark, monkeypatch):
    docs = spark.range(20_000).selectExpr("8L AS doc_id", "concat('text ', id % 3000, ' password = \"hunter', id % 3000, 'x9\"') AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    labels = spark.createDataFrame([(8, 1, 1), (8, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    got = [quality.training_matrix(d, quality.training_labels(labels, "quality", 10), 10) for d in (docs, docs.repartition(7))]
    assert got[0][0].shape == (10, 19) and all(np.array_equal(a, b) for a, b in zip(*got))
    seen = []
    monkeypatch.setattr(trees, "boost", lambda x, y, **more: seen.append(x.shape))
    quality.fit_quality(docs, labels, 10)
    quality_rules.fit_rules(docs, labels, 10)
    assert seen == [(10, 19)] * 2
    models = [toxicity.fit(d, spark.createDataFrame([(8, 1), (9, 0)], "doc_id long, toxic int"), 10) for d in (docs, docs.repartition(5))]
    assert all(np.array_equal(a, b) for a, b in zip(*models))


def test_findings_are_bounded_and_null_ids_train(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("IF(id < 2900, 5L, CAST(NULL AS LONG)) AS doc_id", "concat('password = \"hunter', id % 500, 'x9\"') AS text", "'s' AS source")
    found = C.materialize(secrets.findings(docs), "findings")
    labels = found.select("doc_id", "start", F.lit(1.0).alias("label")).distinct()
    seen = []
    monkeypatch.setattr(secrets, "Judge", lambda rows, book: seen.append(sorted(map(str, rows))))
    for d in (found, found.repartition(5)):
        secrets.train(docs, d, labels, 10)
    assert len(seen[0]) == 10 and seen[0] == seen[1]
    secrets.train(docs, found.where("doc_id IS NULL"), labels, 1000)
    assert len(seen[2]) == 100


def test_dictionary_words_of_any_length(spark):
    docs = spark.createDataFrame([("Configuration, configuration! of the Überwachungsgerät",)] * 3, "text string")
    book = secrets.dictionary(docs)
    assert {"configuration", "the"} <= book.words and "of" not in book.words
    assert book.coverage("the-configuration") == 16 / 17


def test_a_third_of_equal_rows_is_dealt_out(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    one = docs.orderBy("doc_id").limit(1).crossJoin(spark.range(4000).select())
    cut = C.materialize(packing.pieces(one.unionByName(docs), public_tokenizers.path("word_bpe_49k.json"), 2048), "pieces")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.groupBy("length", F.pmod(F.xxhash64("row_hash", "piece", "twin"), F.lit(buckets)).alias("bucket")).count()
    assert dealt.agg(F.max("count")).first()[0] < 4000 / buckets * 2
    ranks = packing.rank_in_length(cut).groupBy("length").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("r"), F.max("rank").alias("m")).collect()
    assert all(r.n == r.r == r.m + 1 for r in ranks)
