"""Table profiling: missing report (A5), describe (A7), column statistics
(A8), profile bundle (A9), distinct counts (A10) and the dataset gate (S6).

Every statistic over all columns is one aggregate job whose one-row result
is turned into a long table (one row per column) with ``stack`` inside
Spark; quantiles reuse the three bounded passes of ``exact_quantiles`` over
a stacked (column, value) table, so a hundred columns cost the same number
of jobs as one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..functions.stats import column_quantiles

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_FLOATING = (T.FloatType, T.DoubleType)


def column_kind(dt: T.DataType) -> str:
    """numeric / categorical / other, as the reference splits ``select_dtypes``
    (booleans are neither, A6)."""
    if isinstance(dt, _NUMERIC):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "categorical"
    return "other"


def _present(df: DataFrame, c: str):
    dt = dict((f.name, f.dataType) for f in df.schema.fields)[c]
    col = F.col(f"`{c}`")
    return F.when(~F.isnan(col), col) if isinstance(dt, _FLOATING) else col


def _stack(one_row: DataFrame, columns: Sequence[str], fields: Sequence[tuple[str, str]]) -> DataFrame:
    """Turn a one-row table with ``{field}_{i}`` columns into one row per column."""
    parts = []
    for i, c in enumerate(columns):
        parts.append(F.struct(F.lit(c).alias("column"),
                              *[F.col(f"{name}_{i}").cast(typ).alias(name) for name, typ in fields]))
    return one_row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def missing_report(df: DataFrame) -> DataFrame:
    """A5: per column the missing count and percentage (NaN counts as missing)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [(F.count(F.lit(1)) - F.count(_present(df, c))).alias(f"missing_{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    one = one.select("*", *[F.when(F.col("__rows") > 0, F.col(f"missing_{i}") * 100.0 / F.col("__rows"))
                             .alias(f"missing_pct_{i}") for i in range(len(cols))])
    return _stack(one, cols, [("missing", "bigint"), ("missing_pct", "double")])


def _moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        v = _present(df, c)
        aggs += [F.count(v).alias(f"count_{i}"), F.avg(v).alias(f"mean_{i}"),
                 F.stddev_samp(v).alias(f"std_{i}"), F.min(v).cast("double").alias(f"min_{i}"),
                 F.max(v).cast("double").alias(f"max_{i}")]
    return df.agg(*aggs)


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None,
                     accuracy: int = 10_000) -> DataFrame:
    """Count, mean, std (sample), min, 25 / 50 / 75 % (exact, linear
    interpolation), max; one row per numeric column."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, count bigint, mean double, std double, "
                                                   "min double, q25 double, q50 double, q75 double, max double")
    moments = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    got = column_quantiles(df, {c: quoted(c) for c in cols}, [0.25, 0.5, 0.75], moments, accuracy)
    rows = [(c, r["count"], r["mean"], r["std"], r["min"], *r["q"], r["max"]) for c, r in got.items()]
    return df.sparkSession.createDataFrame(rows, "column string, count bigint, mean double, std double, min double, "
                                                 "q25 double, q50 double, q75 double, max double")


def column_stats(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numeric columns -> mean, std, min, max, missing; the other
    columns -> unique_count (exact), missing.  Returns (numeric, categorical)."""
    num = numeric_columns(df)
    other = [c for c in df.columns if c not in num]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(num):
        v = _present(df, c)
        aggs += [F.avg(v).alias(f"mean_{i}"), F.stddev_samp(v).alias(f"std_{i}"),
                 F.min(v).cast("double").alias(f"min_{i}"), F.max(v).cast("double").alias(f"max_{i}"),
                 (F.count(F.lit(1)) - F.count(v)).alias(f"missing_{i}")]
    one = df.agg(*aggs)
    numeric = _stack(one, num, [("mean", "double"), ("std", "double"), ("min", "double"),
                                ("max", "double"), ("missing", "bigint")])
    if other:
        miss = missing_report(df.select(*[F.col(f"`{c}`") for c in other])).select("column", "missing")
        uniq = distinct_counts(df, other)
        categorical = uniq.join(miss, "column").select("column", "unique_count", "missing")
    else:
        categorical = df.sparkSession.createDataFrame([], "column string, unique_count bigint, missing bigint")
    return numeric, categorical


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """A10: number of distinct non-null values per column.

    Exact counts stack the columns into (column, value) pairs and group by
    both: map-side partial aggregation removes repeats before the shuffle,
    and no per-column Expand copies of the whole row are made.  With
    ``exact=False`` one ``approx_count_distinct`` aggregate is used.
    """
    cols = list(columns) if columns is not None else list(df.columns)
    if not exact:
        one = df.agg(*[F.approx_count_distinct(_present(df, c)).alias(f"unique_count_{i}")
                       for i, c in enumerate(cols)])
        return _stack(one, cols, [("unique_count", "bigint")])
    types = {f.name: f.dataType for f in df.schema.fields}

    def slots(i, c):
        # typed slots: integers and floats are compared as numbers (no text
        # formatting per value), everything else as text
        v = _present(df, c)
        dt = types[c]
        integral = isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        floating = isinstance(dt, (T.FloatType, T.DoubleType))
        return F.struct(F.lit(i).alias("i"),
                        (v.cast("bigint") if integral else F.lit(None).cast("bigint")).alias("l"),
                        (v.cast("double") if floating else F.lit(None).cast("double")).alias("d"),
                        (v.cast("string") if not (integral or floating) else F.lit(None).cast("string")).alias("s"))
    stacked = (df.select(F.explode(F.array(*[slots(i, c) for i, c in enumerate(cols)])).alias("x"))
               .select("x.*").where(F.col("l").isNotNull() | F.col("d").isNotNull() | F.col("s").isNotNull()))
    per = stacked.distinct().groupBy("i").agg(F.count(F.lit(1)).alias("unique_count"))
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cols)], "i int, column string")
    return (F.broadcast(names).join(per, "i", "left")
            .select("column", F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count")))


def profile_table(df: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One row per column with its type, kind, missing count / percent
    and, for numeric columns, the describe statistics.  The row count is the
    ``rows`` column; the column count is the number of rows of the result."""
    cols = df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in cols if isinstance(types[c], _NUMERIC)]
    miss = missing_report(df)
    meta = df.sparkSession.createDataFrame(
        [(c, types[c].simpleString(), column_kind(types[c])) for c in cols],
        "column string, dtype string, kind string")
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    out = F.broadcast(meta).join(miss, "column")
    if num:
        out = out.join(describe_numeric(df, num, accuracy), "column", "left")
    else:
        for name in ("count", "mean", "std", "min", "q25", "q50", "q75", "max"):
            out = out.withColumn(name, F.lit(None).cast("double"))
    # one-row table of the row count, joined on a constant key (no cross join)
    out = out.withColumn("__k", F.lit(1)).join(F.broadcast(rows.withColumn("__k", F.lit(1))), "__k").drop("__k")
    return out.select("column", "dtype", "kind", "rows", "missing", "missing_pct", "count", "mean",
                      "std", "min", "q25", "q50", "q75", "max")


def validate_dataset(df: DataFrame, min_rows: int = 10, min_cols: int = 2) -> bool:
    """At least ``min_rows`` rows (stops reading after them) and
    ``min_cols`` columns."""
    if len(df.columns) < min_cols:
        return False
    return df.limit(min_rows).count() >= min_rows
