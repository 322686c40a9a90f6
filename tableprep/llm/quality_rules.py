"""Quality rules: base rules first, then gradient-boosted trees with monotonic constraints.

The base rules fail texts of under 50 words and texts in which over half of the words
stand in repeated 3-word windows.  The trees then judge the rest by the same statistics;
more symbols, pipes, exclamation marks, repeated lines, repeated words or words in
capitals can only lower the score (the constraints), whatever the labels say.

Training and scoring work as in ``quality``: at most ``max_rows`` labelled rows, one pass
without a shuffle.  NULL text has no words and fails the base rules; repeated rows are
judged each; with no usable label only the base rules decide (the score is 0.5); an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm import _common as C
from tableprep.llm import doc_stats, quality, trees

FALLING = ("symbols", "pipes", "bangs", "dup_lines", "repeat_words", "caps_words")
LEAST_WORDS, MOST_REPEAT_PERCENT, THRESHOLD = 50, 50, 0.5


def fit_rules(docs: DataFrame, labels: DataFrame, max_rows: int = quality.MAX_ROWS) -> trees.Forest:
    x, y = quality.training_matrix(docs, quality.training_labels(labels, "quality", max_rows), max_rows)
    return trees.boost(x, y, monotone={doc_stats.FEATURES.index(f): -1 for f in FALLING})


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = quality.MAX_ROWS) -> DataFrame:
    rows = quality.score_documents(docs, fit_rules(docs, labels, max_rows), doc_stats.BASE)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    return rows.select("doc_id", *doc_stats.BASE, failed.alias("base_failed"), (~failed & (F.col("score") >= THRESHOLD)).alias("kept"), "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
