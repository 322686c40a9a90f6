"""PrepPlan: the table-preparation request with its fixed stage order.

index -> missing values -> casts -> filter -> dedupe -> sort -> group-by ->
pivot (SURVEY 3.1).  The order is part of the contract: the index is numbered
before rows are removed (gaps stay), dedupe runs after numbering, and a
group-by replaces any earlier sort.  Applying a plan builds one lazy Spark
plan; only fitted statistics (means, medians, modes), order buckets and
pivot values run small jobs of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts
from ..functions.names import quoted
from ..operators import clean, order, reshape


@dataclass(frozen=True)
class PrepPlan:
    # 'yes' adds Index 1..n, 'remove' drops the first column, 'no' / other: nothing
    index: str = "no"
    index_order_by: tuple[str, ...] | None = None
    # (column, strategy) pairs: drop / zero / mean / median / mode / forward / backward
    missing: tuple[tuple[str, str], ...] = ()
    missing_order_by: tuple[str, ...] | None = None
    # (column, target) pairs: int / float / string / datetime / category
    casts: tuple[tuple[str, str], ...] = ()
    on_fraction: str = "error"
    filter: str | None = None
    dedupe: bool = False
    dedupe_order_by: tuple[str, ...] | None = None
    sort_column: str | None = None
    sort_ascending: bool = True
    # (group column, value column, function)
    group: tuple[str, str, str] | None = None
    # (index, columns, values, aggfunc)
    pivot: tuple[str, str, str, str] | None = None
    pivot_values: tuple | None = None
    pivot_max_values: int = 10_000
    on_error: str = "raise"
    extra: dict = field(default_factory=dict)


def apply_casts(df: DataFrame, conversions, on_fraction: str = "error") -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    exprs = {}
    dates = [c for c, target in conversions if target == "datetime" and isinstance(types.get(c), T.StringType)]
    formats = casts.date_formats(df, dates)  # one pass over all date columns
    for c, target in conversions:
        if c not in types:
            raise ValueError(f"unknown column {c!r}")
        src = types[c]
        if target == "int":
            e = casts.to_int(c, src, on_fraction)
        elif target == "float":
            e = casts.to_float(c, src)
        elif target == "string":
            e = casts.to_string(c)
        elif target == "datetime":
            e = casts.to_date(quoted(c), src, formats.get(c, casts.DATE_FORMATS))
        elif target == "category":
            # Categories stay text; encoders (ml.features) give the codes
            e = casts.to_string(c)
        else:
            raise ValueError(f"unknown conversion {target!r}")
        exprs[c] = e.alias(c)
    return df.select(*[exprs.get(c, F.col(f"`{c}`")) for c in df.columns])


def _guard(step, df: DataFrame, on_error: str) -> DataFrame:
    """With on_error='skip' a failing stage leaves the table unchanged."""
    try:
        out = step(df)
        out.schema
        return out
    except Exception:
        if on_error == "skip":
            return df
        raise


def apply_plan(df: DataFrame, plan: PrepPlan) -> DataFrame:
    if plan.index == "yes":
        df = order.add_row_index(df, list(plan.index_order_by) if plan.index_order_by else None)
    elif plan.index == "remove":
        df = reshape.drop_first_column(df)
    if plan.missing:
        mo = list(plan.missing_order_by) if plan.missing_order_by else None
        if mo is None and plan.index == "yes":
            mo = ["Index"]
        df = clean.impute(df, plan.missing, order_by=mo)
    if plan.casts:
        df = apply_casts(df, plan.casts, plan.on_fraction)
    if plan.filter:
        df = reshape.filter_rows(df, plan.filter, on_error=plan.on_error)
    if plan.dedupe:
        df = clean.dedupe(df, order_by=list(plan.dedupe_order_by) if plan.dedupe_order_by else None)
    if plan.sort_column:
        df = reshape.sort_rows(df, plan.sort_column, plan.sort_ascending)
    if plan.group:
        g, v, fn = plan.group
        df = _guard(lambda d: reshape.group_aggregate(d, g, v, fn), df, plan.on_error)
    if plan.pivot:
        i, c, v, fn = plan.pivot
        vals = list(plan.pivot_values) if plan.pivot_values is not None else None
        df = _guard(lambda d: reshape.pivot_table(d, i, c, v, fn, vals, plan.pivot_max_values), df, plan.on_error)
    return df
