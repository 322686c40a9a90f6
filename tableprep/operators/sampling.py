"""Row sets: union (U1), sampling (U2), splits (U3, U4), folds and column
alignment (U5).

Every random decision is a pure function of the row key through
``hash_u32`` (md5 of seed and key), never ``rand()`` / ``randomSplit``:
a recomputed partition after a lost executor, or a different partitioning
of the same rows, makes exactly the same choice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_hex, hash_u32
from ..functions.names import quoted
from ..session import default_parallelism
from .order import add_row_index, rank_within


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append rows by column name; columns missing on one side are NULL."""
    return a.unionByName(b, allowMissingColumns=True)


# Up to this many rows a sample can be a top-k (each task keeps n rows, one
# task merges them); beyond it the rows are numbered by hash with range
# buckets.
TOP_K_LIMIT = 100_000
# A top-k's merge task receives every partition's local top n: allowed only
# while partitions x n (or the candidate count) stays below this.
TOP_K_MERGE_ROWS = 2_000_000


def sample_n(df: DataFrame, n: int, key_cols: Sequence[str], seed: int = 42, partitions: int | None = None) -> DataFrame:
    """The ``n`` rows with the smallest hashes of the key, repeatable and
    independent of partitioning.

    With many partitions the candidates are cut first: hashes are uniform,
    so the ``n`` smallest lie below a 32-bit threshold near ``n / rows`` of
    the range.  Rows under a threshold are a prefix of the sample order, so
    keeping them (with a 5-sigma margin, widened until at least ``n`` pass)
    loses nothing; only those candidates are ranked."""
    n = int(n)
    # rows that share a key follow in the order of their other columns' hash, so the kept ones are fixed
    order = [hash_hex(key_cols, seed), *map(quoted, key_cols), F.xxhash64(*[quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])]
    # the plan is not run to learn its partition count: an upper estimate will do
    parts = partitions or 4 * max(default_parallelism(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)
    if n <= TOP_K_LIMIT and n * parts <= TOP_K_MERGE_ROWS:
        return df.orderBy(*order).limit(n)
    total = df.count()
    if n >= total:
        return df
    frac = n / total + 5.0 * math.sqrt(n) / total
    while True:
        frac = min(frac, 1.0)
        cand = df.where(hash_u32(key_cols, seed) < F.lit(int(math.ceil(frac * 2 ** 32))))
        m = cand.count() if frac < 1.0 else total
        if m >= n or frac >= 1.0:
            break
        frac *= 2
    if n <= TOP_K_LIMIT and min(m, n * parts) <= TOP_K_MERGE_ROWS:
        return cand.orderBy(*order).limit(n)
    keyed = cand.select("*", order[0].alias("__sample_hash"), order[-1].alias("__sample_tie"))
    ranked = add_row_index(keyed, ["__sample_hash", *key_cols, "__sample_tie"], name="__sample_rank")
    return ranked.where(F.col("__sample_rank") <= n).drop("__sample_rank", "__sample_hash", "__sample_tie")


def hash_split(df: DataFrame, key_cols: Sequence[str], train_pct: int = 80,
               seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Seeded train / holdout split: bucket ``hash % 100 < train_pct``."""
    bucket = hash_u32(key_cols, seed) % 100
    return df.where(bucket < train_pct), df.where(bucket >= train_pct)


def stratified_split(df: DataFrame, label_col: str, key_cols: Sequence[str], train_frac: float = 0.8,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """U4: per label, the rows with the smallest hashes form the training
    part: ``n_train = n - ceil((1 - train_frac) * n)`` rows of every label
    (exact per-stratum sizes; skew-safe rank, see ``rank_within``)."""
    keyed = df.withColumn("__split_hash", hash_hex(key_cols, seed))
    ranked = rank_within(keyed, [label_col], ["__split_hash", *key_cols], name="__r", size_name="__n")
    n_train = F.col("__n") - F.ceil(F.lit(1.0 - train_frac) * F.col("__n"))
    marked = ranked.withColumn("__t", F.col("__r") <= n_train)
    train = marked.where("__t").drop("__split_hash", "__r", "__n", "__t")
    hold = marked.where(~F.col("__t")).drop("__split_hash", "__r", "__n", "__t")
    return train, hold


def assign_folds(df: DataFrame, key_cols: Sequence[str], k: int = 5, seed: int = 42,
                 name: str = "fold") -> DataFrame:
    """M4 helper: fold number ``hash % k`` (shuffled K-fold)."""
    return df.withColumn(name, (hash_u32(key_cols, seed) % int(k)).cast("int"))


def align_columns(df: DataFrame, train_columns: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Add training columns absent here as ``fill``, drop extras,
    use the training order."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(fill).alias(c) for c in train_columns])
