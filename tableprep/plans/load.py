"""Load plan: reading a table the way an upload is read.

``load_table`` reads a file or folder, then

* drops a first column that holds nothing but blanks and numbers the rows 1..n in file
  order instead (column ``Index``);
* or else takes a sequential first column (numeric, never falling in file order, starting
  at 0 or 1) as the row label.

The label is an ordinary column with a mark in its schema metadata, which Spark carries
through selects, filters, sorts and joins.  ``label_of`` finds it again, ``feature_names``
leaves it out, ``label_to_column`` makes it a plain column (P10).

The first value is looked up first, which settles most tables.  Only then is the column
(alone) checked, by file splits: each tells whether it falls anywhere inside, its first and
its last value, and that one row per split is put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..operators.order import add_row_index
from ..sources import files

LABEL_MARK = "row_label"


def mark_label(df: DataFrame, column: str) -> DataFrame:
    """``column`` marked as the row label, all other marks removed."""
    exprs = []
    for f in df.schema.fields:
        meta = {k: v for k, v in f.metadata.items() if k != LABEL_MARK} | ({LABEL_MARK: True} if f.name == column else {})
        exprs.append(quoted(f.name).alias(f.name, metadata=meta) if f.name == column or LABEL_MARK in f.metadata else quoted(f.name))
    return df.select(*exprs)


def label_of(df: DataFrame) -> str | None:
    """The row label's name, if the table has one."""
    return next((f.name for f in df.schema.fields if f.metadata.get(LABEL_MARK)), None)


def label_to_column(df: DataFrame, name: str | None = None) -> DataFrame:
    """P10: the label as a plain column, first, under ``name`` if given."""
    label = label_of(df)
    if label is None:
        return df
    rest = [quoted(c) for c in df.columns if c != label]
    return df.select(quoted(label).alias(name or label, metadata={}), *rest)


def feature_names(df: DataFrame, target: str | None = None) -> list[str]:
    """All columns but the label and the target."""
    return [c for c in df.columns if c not in (label_of(df), target)]


def is_sequential(df: DataFrame, column: str) -> bool:
    """S5 in file order: never falling, starting at 0 or 1; a missing value is no sequence.

    ``df`` has to be a scan of files (plain columns of one)."""
    if not isinstance(df.schema[column].dataType, T.NumericType):
        return False
    v = quoted(column).cast("double")
    rows = df.select(F.col("_metadata.file_path").alias("__fp"), F.col("_metadata.file_block_start").alias("__fs"), F.monotonically_increasing_id().alias("__m"), v.alias("__v"))
    start = rows.agg(F.min_by("__v", F.struct("__fp", "__fs", "__m")).alias("v")).first()["v"]
    if start not in (0.0, 1.0):
        return False
    # inside a split rows come in file order; a fall is seen against the row before
    before = F.lag("__v").over(Window.partitionBy("__fp", "__fs").orderBy("__m"))
    falls = rows.withColumn("__fall", F.coalesce(F.col("__v") < before, F.lit(False)) | F.col("__v").isNull() | F.isnan("__v"))
    blocks = falls.groupBy("__fp", "__fs").agg(F.bool_or("__fall").alias("fall"), F.min_by("__v", "__m").alias("first"), F.max_by("__v", "__m").alias("last"))
    cross = F.col("first") < F.lag("last").over(Window.orderBy("__fp", "__fs"))  # one row per split
    return not blocks.select((F.col("fall") | F.coalesce(cross, F.lit(False))).alias("falls")).agg(F.bool_or("falls")).first()[0]


def load_table(spark: SparkSession, path: str, fmt: str | None = None, auto_index: bool = True, index_name: str = "Index", columns: Sequence[str] | None = None, **options) -> DataFrame:
    """S1 + S2 + S5: read, number a table with a blank lead column, or find its row label."""
    df = files.read_table(spark, path, fmt, **options)
    df = df.select(*map(quoted, columns)) if columns else df
    out, dropped = files.drop_empty_lead_column(df)
    if dropped:
        return mark_label(add_row_index(out, name=index_name), index_name)
    if auto_index and df.columns and is_sequential(df, df.columns[0]):
        return mark_label(df, df.columns[0])
    return df
