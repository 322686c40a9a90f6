"""Shared helpers of the training-data operators: tables, scratch tables, text buffers."""

from __future__ import annotations

import atexit
import contextlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.session import ensure_checkpoint_dir

#: Word characters of the contracts: everything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: the lineage is cut, and a
    lost executor costs a reread, never a second run of what made the rows."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Delete materialised tables whose last reader has run.  A task of that reader that is
    lost later would have to be run from the start, so what reads them must be written first."""
    for t in tables:
        _written.remove(t._scratch_path)
        _delete(t.sparkSession, t._scratch_path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch tables written since ``mark()``; results that still read them end."""
    while len(_written) > since:
        _delete(spark, _written.pop())


def mark() -> int:
    return len(_written)


def _at_exit() -> None:
    """What results still read when their session ends goes with it."""
    spark = SparkSession.getActiveSession()
    if _written and spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the session may end at this moment
            release(spark)


atexit.register(_at_exit)

SMALL_ROWS, SMALL_BYTES = 2_000_000, 64 << 20


def is_small(table: DataFrame, row_bytes: int, var: Column | None = None) -> bool:
    """Whether a written table may be broadcast: its rows, of ``row_bytes`` each and ``var`` more, are counted."""
    r = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(0) if var is None else var).alias("b")).first()
    return r["n"] <= SMALL_ROWS and r["n"] * row_bytes + (r["b"] or 0) <= SMALL_BYTES


def keyed_rows(rows: DataFrame, table: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows that may have a partner in a written ``table``, and those that surely have
    none, told apart by the table's keys where those are small enough to broadcast (keys of
    8 bytes); else all rows and None."""
    if not is_small(table, 16 + 8 * len(keys)):
        return rows, None
    marked = rows.join(F.broadcast(table.select(*keys).distinct().withColumn("met__", F.lit(True))), keys, "left")
    return marked.where("met__").drop("met__"), marked.where("met__ IS NULL").drop("met__")


def fresh(name: str, columns: list[str]) -> str:
    """``name``, or as many underscores after it as make it unlike every column (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def word_count(text: str | Column) -> Column:
    """Words of a text, NULL counting as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % F.lit(mod)


def utf8_batch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column as one byte buffer and n + 1 offsets; NULL reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, budget: int):
    """Row ranges [i, j) of at most ``budget`` bytes each (a longer single row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + budget, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
