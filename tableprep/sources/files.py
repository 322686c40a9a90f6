"""File sources and sinks.

CSV is read with every column as text (Spark's ``inferSchema`` would also
invent dates and costs a full pass of its own); missing-value tokens become
NULL, header names are normalised the pandas way, and types are inferred
by ONE aggregate pass of ``try_cast`` checks over all columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import text_to_double, text_to_long
from ..functions.names import quoted

# Text read as missing, the default token list of the pandas
# CSV reader.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# Text read as booleans by the pandas CSV reader.
TRUE_VALUES = ("True", "TRUE", "true")
FALSE_VALUES = ("False", "FALSE", "false")


def normalize_headers(names: Sequence[str | None]) -> list[str]:
    """Blank header -> ``Unnamed: <pos>``; repeated header -> ``a.1``, ``a.2``."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for pos, raw in enumerate(names):
        name = raw if raw not in (None, "") else f"Unnamed: {pos}"
        base = name
        if name in seen:
            k = seen[base]
            while f"{base}.{k}" in seen:
                k += 1
            name = f"{base}.{k}"
            seen[base] = k + 1
        seen.setdefault(name, 1)
        out.append(name)
    return out


def _csv_options(sep: str, multi_line: bool) -> dict:
    """Standard CSV: a quote inside a quoted field is doubled."""
    return {"sep": sep, "quote": '"', "escape": '"', "multiLine": multi_line}


def _csv_header(spark: SparkSession, path: str, options: dict) -> list[str | None]:
    """The header row as written (Spark renames blanks and duplicates)."""
    first = spark.read.options(header=False, **options).csv(path).limit(1).collect()
    if not first:
        raise ValueError(f"empty file: {path}")
    return list(first[0])


def null_tokens(df: DataFrame, na_values: Sequence[str] = NA_VALUES) -> DataFrame:
    """Text columns: missing-value tokens -> NULL."""
    tokens = list(na_values)
    exprs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType) and tokens:
            exprs.append(F.when(c.isin(tokens), F.lit(None)).otherwise(c).alias(f.name))
        else:
            exprs.append(c)
    return df.select(*exprs)


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """S3: the pandas type each text column would get, decided in one pass.

    bigint if every non-null value parses as an integer, else double if every
    value parses as a number, else boolean if every value is a true / false
    token, else string.  A column with no value at all is double (pandas
    reads an all-missing column as float).
    """
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        v = F.trim(F.col(f"`{c}`"))
        present = v.isNotNull()
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.bool_and(~present | text_to_long(v).isNotNull()).alias(f"i{i}"),
            F.bool_and(~present | text_to_double(v).isNotNull()).alias(f"d{i}"),
            F.bool_and(~present | v.isin(*TRUE_VALUES, *FALSE_VALUES)).alias(f"b{i}"),
        ]
    row = df.agg(*aggs).collect()[0]
    out = {}
    for i, c in enumerate(cols):
        if row[f"n{i}"] == 0:
            out[c] = "double"
        elif row[f"i{i}"]:
            out[c] = "bigint"
        elif row[f"d{i}"]:
            out[c] = "double"
        elif row[f"b{i}"]:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    exprs = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        t = types.get(c)
        if t in ("bigint", "double"):
            exprs.append((text_to_long(col) if t == "bigint" else text_to_double(col)).alias(c))
        elif t == "boolean":
            exprs.append(F.when(F.trim(col).isin(*TRUE_VALUES), F.lit(True))
                         .when(F.trim(col).isin(*FALSE_VALUES), F.lit(False)).alias(c))
        else:
            exprs.append(col)
    return df.select(*exprs)


def _checked_rows(spark: SparkSession, path: str, raw_header: list, header: list[str], options: dict) -> DataFrame:
    """Rows as text; a row with more fields than the header fails the job, one with fewer is filled with NULLs.

    Spark compares each file's own header with the schema, unless the header
    has blank or repeated names, which no schema can hold."""
    broken = "__broken_row"
    schema = T.StructType([T.StructField(h, T.StringType()) for h in [*header, broken]])
    rows = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=broken,
                                             enforceSchema=raw_header != header, **options).csv(path)
    # separators outside quotes, so that an empty extra field counts like any other
    bare = F.regexp_replace(F.col(broken), '"(?:[^"]|"")*"', "")
    separators = (F.length(bare) - F.length(F.replace(bare, F.lit(options["sep"]), F.lit("")))) / len(options["sep"])
    fits = (F.when(F.col(broken).isNull() | (separators < len(header)), F.lit(True))
            .otherwise(F.raise_error(F.concat_ws(" ", F.lit(f"more than {len(header)} fields in the row of"), quoted(header[0]), F.lit(":"), F.col(broken)))
                       .cast("boolean")))  # Spark can't read the broken-row column alone, so the message names a field
    return rows.where(fits).drop(broken)


def read_csv(spark: SparkSession, path: str, sep: str = ",", na_values: Sequence[str] = NA_VALUES,
             infer: bool = True, types: dict[str, str] | None = None, multi_line: bool = False) -> DataFrame:
    """S1 + S3: read a CSV file or folder of CSV files.

    Fails on a missing or empty input, on a row with too many fields and on
    files whose headers differ.  ``multi_line`` reads quoted newlines; such a
    file cannot be split, so each is one task.  Pass ``types`` (e.g. saved
    from an earlier ``infer_types``) to skip the inference pass.
    """
    options = _csv_options(sep, multi_line)
    raw_header = _csv_header(spark, path, options)
    header = normalize_headers([v if v is None else v.strip() for v in raw_header])
    df = null_tokens(_checked_rows(spark, path, raw_header, header, options), na_values)
    if df.isEmpty():
        raise ValueError(f"no data rows: {path}")
    if types is None and infer:
        types = infer_types(df)
    return apply_types(df, types or {})


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read CSV (with the pandas-compatible handling above) or Parquet."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "csv":
        return read_csv(spark, path, **options)
    df = spark.read.format(fmt).options(**options).load(path)
    if df.isEmpty():
        raise ValueError(f"no data rows: {path}")
    return df


def drop_empty_lead_column(df: DataFrame) -> tuple[DataFrame, bool]:
    """Drop the first column when every value is NULL or blank; one
    short-circuit-free aggregate.  Returns the table and whether it dropped."""
    if not df.columns:
        return df, False
    first = df.columns[0]
    c = F.col(f"`{first}`")
    empty = df.agg(F.bool_and(c.isNull() | (c.cast("string") == "")).alias("e")).collect()[0]["e"]
    if empty is None or empty:
        return df.drop(first), True
    return df, False


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """Write a result folder (one file per task; never via the driver)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(header=True, quote='"', escape='"', escapeQuotes=True).csv(path)
    else:
        w.format(fmt).save(path)
