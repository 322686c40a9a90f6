"""The corpus pipeline: documents -> packed training sequences.

STAGES, in order: the quality classifier drops the documents it rejects, SimHash
near-dedup leaves one document of each group, secrets are masked, the sources are mixed to
their target weights (a document may come twice or be cut), and what is left is packed
into sequences.  Each stage works on all its predecessor kept, written to the shared
folder and read again; all but the last return the columns of ``documents``.

Models are trained on the tables of ``sf_dir``, so a stage's verdict on a document does
not depend on what earlier stages dropped: the quality model on ``documents`` and
``labels``, the secret scan on the findings in its own input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm import _common as C
from tableprep.llm import mixing, packing, quality, secrets, simhash
from tableprep.llm.registry import importable


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars counted anew from the text."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(like.schema["n_chars"].dataType))
    return docs.select(*map(C.quoted, like.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secrets.redact(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.mix_documents(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned verdicts are not SQL; tests/llm/test_pipeline.py holds every stage against a plain version of it.
ORACLE_SQL = None


@importable
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
