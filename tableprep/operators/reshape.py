"""Projections (P1-P7), filter (F1), sort / head (O1, O2), group-by (A1)
and pivot (A2)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..functions.stats import _group_table_size, exact_quantiles

AGG_FUNCTIONS = ("mean", "sum", "count", "min", "max", "std", "median")
PIVOT_FUNCTIONS = ("mean", "sum", "count", "min", "max")
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_FLOATING = (T.FloatType, T.DoubleType)

# Unpacked bytes that a task of a sort gets, and what a row takes beside its values.
SORT_PART_BYTES = 32 << 20
SORT_ROW_BYTES = 48


def _dtype(df: DataFrame, c: str) -> T.DataType:
    for f in df.schema.fields:
        if f.name == c:
            return f.dataType
    raise ValueError(f"unknown column {c!r}")


def _value(df: DataFrame, c: str) -> Column:
    """Column with NaN read as missing."""
    dt = _dtype(df, c)
    return F.when(~F.isnan(quoted(c)), quoted(c)) if isinstance(dt, _FLOATING) else quoted(c)


# --- projections -----------------------------------------------------------

def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature / target selection."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def drop_first_column(df: DataFrame) -> DataFrame:
    """Remove the first column (no-op on a table without columns)."""
    return df.drop(df.columns[0]) if df.columns else df


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P5."""
    return df.drop(*columns)


def with_derived(df: DataFrame, name: str, expr: str | Column) -> DataFrame:
    """Add a computed column (SQL text or Column)."""
    return df.withColumn(name, F.expr(expr) if isinstance(expr, str) else expr)


def map_labels(df: DataFrame, column: str, mapping: Mapping, out_col: str | None = None,
               default=None) -> DataFrame:
    """Code -> label lookup through a literal map (narrow, no join)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    looked = F.element_at(m, quoted(column)) if mapping else F.lit(None)
    if default is not None:
        looked = F.coalesce(looked, F.lit(default))
    return df.withColumn(out_col or column, looked)


# --- filter / sort / head -------------------------------------------------

def filter_rows(df: DataFrame, condition: str | Column | None, on_error: str = "raise") -> DataFrame:
    """keep rows matching a Spark SQL predicate.  Blank means no filter.

    The predicate is checked when the plan is analysed, before any data is
    read.  ``on_error='skip'`` returns the table unchanged on a bad
    predicate, as the reference does (D14).  Comparisons follow SQL
    three-valued logic (D24): use ``IS DISTINCT FROM`` for pandas' ``!=``.
    """
    if condition is None or (isinstance(condition, str) and not condition.strip()):
        return df
    try:
        cond = F.expr(condition.strip()) if isinstance(condition, str) else condition
        out = df.where(cond)
        out.schema  # force analysis
        return out
    except (AnalysisException, Exception):
        if on_error == "skip":
            return df
        raise


def sort_rows(df: DataFrame, column: str | None, ascending: bool = True, first: int | None = None) -> DataFrame:
    """O1: sort by one column, missing values last either way.
    Rows of one value follow in the order of their hash, so that a value
    (or NULL) that most rows share is spread over the sorted partitions;
    rows equal in every column are spread by the partition they come from,
    which a stage that runs again finds the same.  Partitions follow the
    unpacked bytes of the rows (``SORT_PART_BYTES``): rows that repeat pack
    so well that a few tasks would get all of them.
    ``first`` keeps that many rows, a top-k that shuffles nothing else.
    An absent or blank column leaves the table unchanged."""
    if not column or column not in df.columns:
        return df if first is None else df.limit(first)
    v = _value(df, column)
    v = v.asc_nulls_last() if ascending else v.desc_nulls_last()
    hashed = F.xxhash64(*[quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    if first is not None:
        return df.orderBy(v, hashed).limit(first)
    if df.isStreaming:
        return df.orderBy(v, hashed)
    # a number of partitions that is asked for is not merged by their packed size
    parts = -(-_group_table_size(df, df.columns, SORT_ROW_BYTES)[1] // SORT_PART_BYTES)
    order = [v, hashed, F.col("__from")]
    return df.withColumn("__from", F.spark_partition_id()).repartitionByRange(max(1, parts), *order).orderBy(*order).drop("__from")


def head_rows(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None,
              ascending: bool = True) -> DataFrame:
    """O2 / O1+limit: first ``n`` rows by an order (a distributed top-k)."""
    if order_by:
        keys = [quoted(c).asc_nulls_last() if ascending else quoted(c).desc_nulls_last() for c in order_by]
        return df.orderBy(*keys).limit(n)
    return df.limit(n)


# --- group-by ---------------------------------------------------------------

def group_aggregate(df: DataFrame, group_col: str, agg_col: str, func: str,
                    accuracy: int = 10_000) -> DataFrame:
    """A1: one key, one aggregate, output column ``<agg_col>_<func>``.

    Rows with a NULL key are dropped (D5).  ``sum`` of an all-missing group
    is 0 (D6), ``std`` is the sample deviation (D7).  ``median`` is exact
    and skew-safe (see ``exact_quantiles``).
    """
    if func not in AGG_FUNCTIONS:
        raise ValueError(f"unknown aggregate {func!r}; choose one of {AGG_FUNCTIONS}")
    out = f"{agg_col}_{func}"
    dt = _dtype(df, agg_col)
    if func in ("mean", "sum", "std", "median") and not isinstance(dt, _NUMERIC):
        raise ValueError(f"{func} needs a numeric column; {agg_col!r} is {dt.simpleString()}")
    keyed = df.where(_value(df, group_col).isNotNull())
    if func == "median":
        return exact_quantiles(keyed, agg_col, [0.5], [group_col], accuracy=accuracy, names=[out])
    v = _value(df, agg_col)
    agg = {
        "mean": F.avg(v),
        "sum": F.coalesce(F.sum(v), F.lit(0).cast(_sum_type(dt))),
        "count": F.count(v),
        "min": F.min(v),
        "max": F.max(v),
        "std": F.stddev_samp(v),
    }[func]
    return keyed.groupBy(quoted(group_col)).agg(agg.alias(out))


def _sum_type(dt: T.DataType) -> str:
    return "double" if isinstance(dt, (T.FloatType, T.DoubleType)) else (
        "decimal(38,18)" if isinstance(dt, T.DecimalType) else "bigint")


# --- pivot --------------------------------------------------------------------

def pivot_values(df: DataFrame, column: str, max_values: int = 10_000) -> list:
    """Distinct non-null values of the pivot column, sorted; one distinct job.
    More than ``max_values`` values is an error, not a silent truncation."""
    rows = (df.where(_value(df, column).isNotNull()).select(quoted(column)).distinct()
            .orderBy(quoted(column)).limit(max_values + 1).collect())
    if len(rows) > max_values:
        raise ValueError(f"pivot column {column!r} has more than {max_values} distinct values: "
                         "use pivot_cells for the long (index, column, value) form")
    return [r[0] for r in rows]


def pivot_cells(df: DataFrame, index: str, columns: str, values: str, aggfunc: str = "mean") -> DataFrame:
    """A2 in long form: one row per (index, column value) cell, with the
    pivot's NULL rules (D5, D26).  Exact for any number of column values;
    ``pivot_table`` spreads these cells into one column per value."""
    if aggfunc not in PIVOT_FUNCTIONS:
        raise ValueError(f"unknown pivot aggregate {aggfunc!r}; choose one of {PIVOT_FUNCTIONS}")
    dt = _dtype(df, values)
    if aggfunc in ("mean", "sum") and not isinstance(dt, _NUMERIC):
        raise ValueError(f"{aggfunc} needs a numeric column; {values!r} is {dt.simpleString()}")
    v = _value(df, values)
    keyed = df.where(_value(df, index).isNotNull() & _value(df, columns).isNotNull())
    if aggfunc in ("mean", "min", "max"):
        keyed = keyed.where(v.isNotNull())
    cell = {
        "mean": F.avg(v),
        "sum": F.coalesce(F.sum(v), F.lit(0).cast(_sum_type(dt))),
        "count": F.count(v),
        "min": F.min(v),
        "max": F.max(v),
    }[aggfunc]
    return keyed.groupBy(quoted(index), quoted(columns)).agg(cell.alias("__cell"))


def pivot_table(df: DataFrame, index: str, columns: str, values: str, aggfunc: str = "mean",
                column_values: Sequence | None = None, max_values: int = 10_000) -> DataFrame:
    """A2: index x columns table of one aggregate.

    Two phases: ``groupBy(index, columns)`` (partial + final aggregation,
    skew-safe) then a pivot of that one-row-per-cell table.  NULL keys are
    dropped (D5).  For mean / min / max, cells, index rows and column values
    with no non-null value vanish; for sum / count an all-missing cell is 0
    and an absent combination is NULL (D26).  The output has one column per
    value, so more than ``max_values`` values is an error (the long form,
    ``pivot_cells``, has no such bound).
    """
    cells = pivot_cells(df, index, columns, values, aggfunc)
    vals = list(column_values) if column_values is not None else pivot_values(cells, columns, max_values)
    return cells.withColumnRenamed(columns, "__pivot").groupBy(quoted(index)).pivot("__pivot", vals).agg(F.first("__cell"))
