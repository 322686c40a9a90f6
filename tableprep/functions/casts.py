"""Coercing casts (C1-C6) as column expressions.

Spark 4 runs with ANSI mode on, so every coercion goes through ``try_cast`` /
``try_to_timestamp``: unparsable input becomes NULL instead of failing the
job.  All functions return a ``Column`` and touch no data, but for ``date_layouts`` and
``date_formats``, which look at a whole column once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import quoted

# Date/time formats tried in order when a string column is cast to a date
# (Spark datetime pattern syntax).  First match wins; lone letters such as
# ``M`` also take one digit.
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy-M-d H:m[:s][.SSSSSS][.SSS]",
    "yyyy-M-d'T'H:m[:s][.SSSSSS][.SSS][XXX]",
    "yyyy-M-d H:m[:s][.SSSSSS][.SSS]XXX",
    "yyyy/M/d",
    "yyyy/M/d H:m[:s]",
    "M/d/yyyy",
    "M/d/yyyy H:m[:s]",
    "M-d-yyyy",
    "d.M.yyyy",
    "yyyyMMdd",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "MMM d yyyy",
    "MMMM d yyyy",
)

# Layouts that read the same texts in the other order of day and month.  A column has one
# order: see ``date_formats``.
DAY_FIRST_FORMATS = {
    "M/d/yyyy": "d/M/yyyy",
    "M/d/yyyy H:m[:s]": "d/M/yyyy H:m[:s]",
    "M-d-yyyy": "d-M-yyyy",
}

# Nanoseconds, microseconds, milliseconds or seconds per epoch unit.
_EPOCH_DIVISOR_TO_SECONDS = {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1.0}

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


# What counts as a number in text.  Spark's own cast also takes type suffixes
# and hexadecimal floats (10D, 1f, 0x1p3), which are codes here, not numbers.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"


def text_to_double(text: Column) -> Column:
    """Double of a text that reads as a number, NULL for any other."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def text_to_long(text: Column) -> Column:
    """Bigint of a text that reads as an integer, NULL for any other."""
    t = F.trim(text)
    return F.when(t.rlike(INTEGER_PATTERN), t.try_cast("bigint"))


def _as_double(c: Column, source_type: T.DataType | None) -> Column:
    """Double of a column of known numeric type, or by way of its text."""
    return c.cast("double") if isinstance(source_type, NUMERIC_TYPES) else text_to_double(c.cast("string"))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN is not a missing marker in Spark; turn it into NULL."""
    c = _col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_float(c, source_type: T.DataType | None = None) -> Column:
    """Numeric coercion to double; unparsable text and NaN become NULL."""
    c = _col(c)
    if isinstance(source_type, T.BooleanType):
        return c.cast("double")
    return nan_to_null(_as_double(c, source_type))


def to_int(c, source_type: T.DataType | None = None, on_fraction: str = "error") -> Column:
    """Coercion to bigint.

    Unparsable values become NULL.  A value with a fractional part is handled
    by ``on_fraction``: ``'error'`` fails the job (as the reference does),
    ``'null'`` gives NULL, ``'truncate'`` drops the fraction.
    """
    if on_fraction not in ("error", "null", "truncate"):
        raise ValueError(f"on_fraction must be error, null or truncate, not {on_fraction!r}")
    c = _col(c)
    if isinstance(source_type, INTEGRAL_TYPES):
        return c.cast("bigint")
    if isinstance(source_type, T.BooleanType):
        return c.cast("bigint")
    if isinstance(source_type, T.DecimalType):
        exact, d = F.when(c == F.floor(c), c.try_cast("bigint")), c
    elif isinstance(source_type, (T.FloatType, T.DoubleType)):
        exact, d = None, nan_to_null(c.cast("double"))
    else:
        exact, d = text_to_long(c.cast("string")), nan_to_null(text_to_double(c.cast("string")))
    whole = F.when(d == F.floor(d), d.try_cast("bigint"))
    if on_fraction == "null":
        via_double = whole
    elif on_fraction == "truncate":
        via_double = d.try_cast("bigint")
    else:
        via_double = (F.when(d.isNotNull() & (d != F.floor(d)),
                             F.raise_error(F.concat(F.lit("cannot cast fractional value to int: "),
                                                    d.cast("string"))).cast("bigint"))
                      .otherwise(whole))
    return F.coalesce(exact, via_double) if exact is not None else via_double


def to_string(c, null_token: str | None = None) -> Column:
    """Cast to string; NULL stays NULL unless ``null_token`` is given."""
    s = _col(c).cast("string")
    return s if null_token is None else F.coalesce(s, F.lit(null_token))


def to_date(c, source_type: T.DataType | None = None, formats=DATE_FORMATS,
            epoch_unit: str = "ns") -> Column:
    """C4: cast to date.

    Strings are parsed with the first matching format of ``formats`` (``date_formats``
    finds those of a column);
    numbers are read as an epoch count in ``epoch_unit`` (nanoseconds by
    default, so a small integer id becomes 1970-01-01 as in the reference).
    """
    c = _col(c)
    if isinstance(source_type, (T.DateType,)):
        return c
    if isinstance(source_type, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    if isinstance(source_type, NUMERIC_TYPES):
        if epoch_unit not in _EPOCH_DIVISOR_TO_SECONDS:
            raise ValueError(f"epoch_unit must be one of {sorted(_EPOCH_DIVISOR_TO_SECONDS)}")
        micros = F.floor(c.cast("double") * F.lit(1e6 / _EPOCH_DIVISOR_TO_SECONDS[epoch_unit]))
        return F.to_date(F.timestamp_micros(micros))
    s = F.trim(c.cast("string"))
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt in formats])
    return F.to_date(parsed)


def date_layouts(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """How many values of each text column every layout reads: column, layout, day_first
    (NULL where a layout leaves no choice), parsed, present.  One aggregate over the table,
    all columns and layouts side by side."""
    layouts = [(f, None if f not in DAY_FIRST_FORMATS else False) for f in formats] + [(DAY_FIRST_FORMATS[f], True) for f in formats if f in DAY_FIRST_FORMATS]
    text = [F.trim(quoted(c).cast("string")) for c in columns]
    aggs = [F.count(t).alias(f"n{i}") for i, t in enumerate(text)]
    aggs += [F.count(F.try_to_timestamp(t, F.lit(f))).alias(f"p{i}_{j}") for i, t in enumerate(text) for j, (f, _) in enumerate(layouts)]
    row = df.agg(*aggs).first()
    rows = [(c, f, first, row[f"p{i}_{j}"], row[f"n{i}"]) for i, c in enumerate(columns) for j, (f, first) in enumerate(layouts)]
    return df.sparkSession.createDataFrame(rows, "column string, layout string, day_first boolean, parsed long, present long")


def date_formats(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = DATE_FORMATS) -> dict[str, tuple[str, ...]]:
    """C4: the layouts to read each text column with, decided from the whole column.

    A column has one order of day and month: day first if those layouts read more of its
    values than the month-first ones do (values over 12 decide), else month first.  The
    layouts of the other order are left out, so a value that only they read becomes NULL.
    Of the rest, those that read most values come first; equal ones keep their order in
    ``formats``."""
    found: dict[str, list] = {c: [] for c in columns}
    for r in date_layouts(df, columns, formats).collect() if columns else []:
        found[r["column"]].append(r)
    out = {}
    for c, rows in found.items():
        read = {first: sum(r["parsed"] for r in rows if r["day_first"] is first) for first in (True, False)}
        other = not read[True] > read[False]  # the order that the column does not have
        kept = [r for r in rows if r["day_first"] is not other]
        out[c] = tuple(r["layout"] for r in sorted(kept, key=lambda r: -r["parsed"]))
    return out


def coerce_default(c, default, to: str = "double") -> Column:
    """Numeric coercion with a fallback value for NULL / unparsable."""
    if to not in ("double", "bigint"):
        raise ValueError("to must be 'double' or 'bigint'")
    v = text_to_double(_col(c).cast("string"))
    if to == "double":
        v = nan_to_null(v)
        return F.coalesce(v, F.lit(float(default)))
    return F.coalesce(nan_to_null(v).try_cast("bigint"), F.lit(int(default)).cast("bigint"))
