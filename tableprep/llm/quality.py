"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training rows: at most ``max_rows`` labelled documents, those of the least md5 of their id
and, where an id stands for several texts, of the least text hash (so the choice depends on
the rows alone).  The statistics of the documents with a chosen label are computed by
Spark, equal rows are counted once, and a distributed top-k keeps ``max_rows`` of them; so
at most ``max_rows`` x 19 numbers reach the driver, where the trees are grown, even if
one labelled id stands in a third of the table.  Scoring walks the flat node arrays for a whole batch
at once, in one pass over the documents without a shuffle.

NULL text counts as empty; empty texts get the score of their (all zero) statistics; a
NULL doc_id is not held out and meets no label; repeated documents are scored each;
repeated documents and labels train once; NULL labels don't train; with no usable label the score
is 0.5 throughout; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.functions.hashing import hash_hex
from tableprep.llm import _common as C
from tableprep.llm import doc_stats, trees

MAX_ROWS = 16_000
THRESHOLD = 0.7


def held_out(doc_id: str, mod: int, rest: int) -> Column:
    return F.coalesce(C.crc_fold(doc_id, mod) == rest, F.lit(False))


def training_labels(labels: DataFrame, label: str, max_rows: int, use: Column | None = None) -> DataFrame:
    """(doc_id, y): at most ``max_rows`` different labelled ids, of the least md5; the documented bound of the fit."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows if use is None else rows.where(use)
    return rows.select("doc_id", F.col(label).cast("double").alias("y")).distinct().orderBy(hash_hex(["doc_id"]), "y").limit(max_rows)


def training_texts(docs: DataFrame, labels: DataFrame, seed: int = 42) -> DataFrame:
    """turn (md5 of the id), h (hash of the text), y and text of every document with one of the (bounded) labels."""
    # `labels` is bounded by max_rows, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")
    return rows.select(hash_hex(["doc_id"], seed).alias("turn"), F.xxhash64("text").alias("h"), "y", "text")


def bounded(rows: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows, one for each (turn, h, y), by those in order.  The rest of a
    row follows from its text, so any of the equal ones will do."""
    rest = [c for c in rows.columns if c not in ("turn", "h", "y")]
    once = rows.groupBy("turn", "h", "y").agg(*[F.any_value(c).alias(c) for c in rest])
    return once.orderBy("turn", "h", "y").limit(max_rows)


def training_matrix(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_rows`` training rows."""
    def run(batches):
        for batch in batches:
            x = doc_stats.features(doc_stats.measure(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(x), pa.list_(pa.float64()))], names=["turn", "h", "y", "x"])

    rows = bounded(training_texts(docs, labels).mapInArrow(run, "turn string, h long, y double, x array<double>"), max_rows).collect()
    rows.sort(key=lambda r: (r.x, r.y))  # the fit must not depend on the order of arrival
    return np.array([r.x for r in rows], float).reshape(-1, len(doc_stats.FEATURES)), np.array([r.y for r in rows], float)


def score_documents(docs: DataFrame, model: trees.Forest, columns: list[str] = ()) -> DataFrame:
    """doc_id, score and the wanted counts of ``doc_stats`` for every document."""
    def run(batches):
        for batch in batches:
            s = doc_stats.measure(batch.column(1))
            score = model.probability(doc_stats.features(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), *(pa.array(s[c]) for c in columns)], names=["doc_id", "score", *columns])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", "score double", *(f"{c} long" for c in columns)]))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> trees.Forest:
    x, y = training_matrix(docs, training_labels(labels, "quality", max_rows, ~held_out("doc_id", 4, 2)), max_rows)
    return trees.boost(x, y)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    scored = score_documents(docs, fit_quality(docs, labels, max_rows))
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: trees.Forest) -> DataFrame:
    """The documents that the classifier predicts as 1, all columns as they came."""
    def run(batches):
        for batch in batches:
            x = doc_stats.features(doc_stats.measure(batch.column(at)))
            yield batch.filter(pa.array(model.probability(x) >= THRESHOLD))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)


def op3_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
