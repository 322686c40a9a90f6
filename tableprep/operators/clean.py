"""Missing-value handling (N1-N8) and duplicate removal.

Statistics used for filling (mean, median, mode) are fitted with one Spark
aggregate and re-applied as literals, so the fill itself is a narrow column
expression: no join, no extra shuffle, and the plan does not recompute the
statistic when a stage is retried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..functions.stats import column_quantiles
from .order import fill_ordered

STRATEGIES = ("drop", "zero", "mean", "median", "mode", "forward", "backward")
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_FLOATING = (T.FloatType, T.DoubleType)


# Typed places of a value among the stacked columns of a mode fit: integer,
# double, decimal, text, anything else in text form.
SLOTS = ("l", "d", "m", "s", "o")


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _missing(c: str, dt: T.DataType):
    """NULL, or NaN for floating columns (D1: one missing marker)."""
    col = quoted(c)
    return col.isNull() | F.isnan(col) if isinstance(dt, _FLOATING) else col.isNull()


def _present(c: str, dt: T.DataType):
    col = quoted(c)
    return F.when(~F.isnan(col), col) if isinstance(dt, _FLOATING) else col


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows missing a value in any of ``columns``."""
    types = _types(df)
    cond = None
    for c in columns:
        m = _missing(c, types[c])
        cond = m if cond is None else cond | m
    return df if cond is None else df.where(~cond)


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing -> 0 (``'0'`` for text, ``false`` for booleans)."""
    types = _types(df)
    fills = {}
    for c in columns:
        dt = types[c]
        if isinstance(dt, T.StringType):
            zero = F.lit("0")
        elif isinstance(dt, T.BooleanType):
            zero = F.lit(False)
        else:
            zero = F.lit(0).cast(dt)
        fills[c] = F.coalesce(_present(c, dt), zero).alias(c)
    return df.select(*[fills.get(c, quoted(c)) for c in df.columns])


def fit_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Means of numeric columns in one aggregate (NaN ignored)."""
    types = _types(df)
    cols = [c for c in columns if isinstance(types[c], _NUMERIC)]
    if not cols:
        return {}
    row = df.agg(*[F.avg(_present(c, types[c])).alias(f"m{i}") for i, c in enumerate(cols)]).collect()[0]
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def fit_medians(df: DataFrame, columns: Sequence[str], accuracy: int = 10_000) -> dict[str, float | None]:
    """Exact medians of numeric columns, all in the two scans of ``column_quantiles``."""
    types = _types(df)
    cols = [c for c in columns if isinstance(types[c], _NUMERIC)]
    if not cols:
        return {}
    got = column_quantiles(df, {c: quoted(c) for c in cols}, [0.5], accuracy=accuracy)
    return {c: got[c]["q"][0] for c in cols}


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, smallest on ties (D10), for all
    columns in one job: (column, value) pairs are counted with partial
    aggregation, then ``min(struct(-count, value))`` picks each winner.
    Values sit in a typed slot (integer / double / text / other) so numbers
    compare as numbers."""
    cols = list(columns)
    if not cols:
        return {}
    types = _types(df)

    def slot(c: str, kind: str):
        dt = types[c]
        integral = isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        floating, exact = isinstance(dt, _FLOATING), isinstance(dt, T.DecimalType)
        text = isinstance(dt, T.StringType)
        v = _present(c, dt)
        pick = {"l": integral, "d": floating, "m": exact, "s": text, "o": not (integral or floating or exact or text)}[kind]
        cast = {"l": "bigint", "d": "double", "m": "decimal(38,18)", "s": "string", "o": "string"}[kind]
        return (v.cast(cast) if pick else F.lit(None).cast(cast)).alias(kind)

    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), *[slot(c, k) for k in SLOTS]) for i, c in enumerate(cols)
    ])).alias("x")).select("x.*").where(
        F.coalesce(*(F.col(k).cast("string") for k in SLOTS)).isNotNull())
    counted = stacked.groupBy("i", *SLOTS).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("neg"), *SLOTS)).alias("b"))
    out: dict[str, object] = {c: None for c in cols}
    for r in best.collect():  # one row per column
        c = cols[r["i"]]
        b = r["b"]
        # other types (dates, booleans, ...) come back in text form; the fill
        # casts the literal to the column type
        out[c] = next((b[k] for k in SLOTS if b[k] is not None), None)
    return out


def _fill_literals(df: DataFrame, values: dict) -> DataFrame:
    types = _types(df)
    exprs = {}
    for c, v in values.items():
        if v is None:
            continue
        dt = types[c]
        if isinstance(v, float) and isinstance(dt, _NUMERIC) and not isinstance(dt, _FLOATING):
            # int column filled with a fractional statistic becomes double (D3)
            exprs[c] = F.coalesce(quoted(c).cast("double"), F.lit(v)).alias(c)
        else:
            exprs[c] = F.coalesce(_present(c, dt), F.lit(v).cast(dt)).alias(c)
    return df.select(*[exprs.get(c, quoted(c)) for c in df.columns])


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric columns only; other columns are left as they are."""
    return _fill_literals(df, fit_means(df, columns))


def fill_median(df: DataFrame, columns: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """Exact (interpolated) median, numeric columns only."""
    return _fill_literals(df, fit_medians(df, columns, accuracy))


def fill_mode(df: DataFrame, columns: Sequence[str], unknown: str = "Unknown") -> DataFrame:
    """Most frequent value; an all-missing text column gets ``unknown``."""
    types = _types(df)
    modes = fit_modes(df, columns)
    for c in columns:
        if modes.get(c) is None and isinstance(types[c], T.StringType):
            modes[c] = unknown
    return _fill_literals(df, modes)


def impute(df: DataFrame, plan: Sequence[tuple[str, str]], order_by: Sequence[str] | None = None,
           accuracy: int = 10_000) -> DataFrame:
    """Apply ``(column, strategy)`` steps in list order.

    A blank strategy leaves the column alone.  Consecutive steps that need a
    statistic of columns no earlier step of the run changed share one
    fitting job; a ``drop`` or a fill of the same column ends the run, since
    it changes the data later statistics are taken on.
    ``forward`` / ``backward`` need ``order_by`` (the row order).
    """
    steps = [(c, (s or "").strip()) for c, s in plan]
    for c, s in steps:
        if s and s not in STRATEGIES:
            raise ValueError(f"unknown strategy {s!r} for column {c!r}")
        if c not in df.columns:
            raise ValueError(f"unknown column {c!r}")
    i = 0
    while i < len(steps):
        c, s = steps[i]
        if not s:
            i += 1
            continue
        if s == "drop":
            df = drop_missing(df, [c])
            i += 1
            continue
        if s in ("forward", "backward"):
            if not order_by:
                raise ValueError("forward / backward fill needs order_by")
            # a run of fills in one direction is one pass, as long as the rows' order isn't what is filled
            run = []
            while i < len(steps) and steps[i][1] == s and steps[i][0] not in run and not (run and set(run) & set(order_by)):
                run.append(steps[i][0])
                i += 1
            df = fill_ordered(df, run, order_by, s)
            continue
        # A run of statistic fills on distinct columns, fitted together.
        run, touched = [], set()
        while i < len(steps) and steps[i][1] in ("zero", "mean", "median", "mode") and steps[i][0] not in touched:
            run.append(steps[i])
            touched.add(steps[i][0])
            i += 1
        by = {}
        for col, strat in run:
            by.setdefault(strat, []).append(col)
        values: dict = {}
        values.update(fit_means(df, by.get("mean", [])))
        values.update(fit_medians(df, by.get("median", []), accuracy))
        types = _types(df)
        modes = fit_modes(df, by.get("mode", []))
        for col in by.get("mode", []):
            if modes.get(col) is None and isinstance(types[col], T.StringType):
                modes[col] = "Unknown"
        values.update(modes)
        df = fill_zero(df, by.get("zero", []))
        df = _fill_literals(df, values)
    return df


def dedupe(df: DataFrame, subset: Sequence[str] | None = None,
           order_by: Sequence[str] | None = None) -> DataFrame:
    """remove duplicate rows (NULLs compare equal, as in pandas).

    Whole-row duplicates use ``dropDuplicates``.  Otherwise the row first
    by ``order_by`` (then by the rest of the row) is kept, deterministically: a ``min(struct(order, rest))`` aggregate, which
    Spark combines map-side, so a group holding a third of the rows is
    collapsed before the shuffle.
    """
    keys = list(subset) if subset else list(df.columns)
    if not order_by and len(keys) == len(df.columns):
        return df.dropDuplicates(keys)
    # With a subset the kept row must not depend on task timing (a
    # recomputed stage would otherwise keep another row): take the first by
    # ``order_by`` and then by the rest of the row.
    order = [c for c in (order_by or [])]
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min(F.struct(*[quoted(c).alias(f"o{i}") for i, c in enumerate(order)],
                          *[quoted(c).alias(f"r{i}") for i, c in enumerate(rest)])).alias("__k")
    kept = df.groupBy(*keys).agg(best)
    sel = {c: quoted(c) for c in keys}
    sel.update({c: F.col(f"__k.o{i}").alias(c) for i, c in enumerate(order) if c not in keys})
    sel.update({c: F.col(f"__k.r{i}").alias(c) for i, c in enumerate(rest)})
    return kept.select(*[sel[c] for c in df.columns])


def dedupe_with_count(df: DataFrame, subset: Sequence[str] | None = None,
                      order_by: Sequence[str] | None = None) -> tuple[DataFrame, int]:
    """F3 with the number of removed rows (two counts)."""
    out = dedupe(df, subset, order_by)
    return out, df.count() - out.count()
