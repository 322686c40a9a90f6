"""Feature preparation.

Fitting collects only bounded state: a flag per column, the sorted category
list of each categorical column, and a mean / deviation per numeric column.
Applying the state is a set of column expressions built from literals, so
scoring tables and streams need no join and no statistic is recomputed on
the scoring data (D15).  The one exception is label encoding of a column
with more than ``LITERAL_CATEGORIES`` values: its exact value -> code table
is a checkpointed Spark table joined to the rows, so no category count is
capped and no category list passes through the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_FLOATING = (T.FloatType, T.DoubleType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _present(c: str, dt: T.DataType) -> Column:
    col = quoted(c)
    # NaN is missing, and -0.0 is the value 0.0
    return F.when(~F.isnan(col), F.when(col == 0, F.lit(0.0).cast(dt)).otherwise(col)) if isinstance(dt, _FLOATING) else col


def category_key(c: str, dt: T.DataType) -> Column:
    """A category as it stands in a literal list: as it is, decimals as doubles, dates as texts."""
    key = _present(c, dt)
    return key if isinstance(dt, (T.BooleanType, T.StringType, *_INTEGRAL)) else key.cast("double" if isinstance(dt, _NUMERIC) else "string")


# --- detection -------------------------------------------------------------------

def detect_categoricals(df: DataFrame, max_unique: int = 20, columns: Sequence[str] | None = None) -> list[str]:
    """L1: text and boolean columns, plus numeric columns whose non-null
    values are all 0 or 1 (and, for ``max_unique <= 2``, fewer than
    ``max_unique`` distinct values).  One aggregate job."""
    types = _types(df)
    cols = list(columns) if columns is not None else list(df.columns)
    out = [c for c in cols if isinstance(types[c], (T.StringType, T.BooleanType))]
    num = [c for c in cols if isinstance(types[c], _NUMERIC)]
    if num:
        aggs = []
        for i, c in enumerate(num):
            v = _present(c, types[c])
            aggs += [F.count(v).alias(f"n{i}"), F.bool_and(v.isNull() | v.isin(0, 1)).alias(f"b{i}")]
            if max_unique <= 2:
                aggs.append(F.count_distinct(v).alias(f"u{i}"))
        row = df.agg(*aggs).collect()[0]
        for i, c in enumerate(num):
            ok = row[f"n{i}"] > 0 and bool(row[f"b{i}"])
            if max_unique <= 2:
                ok = ok and row[f"u{i}"] < max_unique
            if ok:
                out.append(c)
    return [c for c in cols if c in out]


def categorical_report(df: DataFrame, max_unique: int = 20) -> DataFrame:
    """L1 as a table: column, is_categorical."""
    cats = set(detect_categoricals(df, max_unique))
    return df.sparkSession.createDataFrame([(c, c in cats) for c in df.columns],
                                           "column string, is_categorical boolean")


def recommend_categoricals(df: DataFrame, exclude: Sequence[str] = (), min_unique: int = 2,
                           max_unique: int = 50, max_ratio: float = 0.3) -> DataFrame:
    """L2: numeric columns not already categorical whose distinct count is in
    [min_unique, max_unique] and at most ``max_ratio`` of the non-null count.

    All counts are exact (D21: an all-null column is never recommended).
    Returns column, unique_count, non_null, unique_ratio, recommended for
    every numeric column considered.
    """
    types = _types(df)
    skip = set(exclude) | set(detect_categoricals(df))
    cols = [c for c in df.columns if isinstance(types[c], _NUMERIC) and c not in skip]
    spark = df.sparkSession
    schema = "column string, unique_count bigint, non_null bigint, unique_ratio double, recommended boolean"
    if not cols:
        return spark.createDataFrame([], schema)
    counted = df.agg(*[F.count(_present(c, types[c])).alias(f"n{i}") for i, c in enumerate(cols)]).collect()[0]
    from ..operators.profile import distinct_counts
    unique = {r["column"]: r["unique_count"] for r in distinct_counts(df, cols).collect()}
    rows = []
    for i, c in enumerate(cols):
        nn, u = counted[f"n{i}"], unique.get(c, 0)
        ratio = (u / nn) if nn else None
        rec = bool(nn) and min_unique <= u <= max_unique and ratio <= max_ratio
        rows.append((c, int(u), int(nn), ratio, rec))
    return spark.createDataFrame(rows, schema)


def feature_columns(df: DataFrame, target: str | None = None, id_col: str | None = None,
                    first_column_is_id: bool = True) -> tuple[str | None, list[str]]:
    """The row-label column (the first column by default) and the
    feature columns: everything except the label and the target."""
    ident = id_col if id_col is not None else (df.columns[0] if first_column_is_id and df.columns else None)
    feats = [c for c in df.columns if c not in (ident, target)]
    return ident, feats


# --- fitted state -------------------------------------------------------------------

def _sort_key(v):
    return (0, v) if isinstance(v, (int, float)) else (1, str(v))


def _distinct_values(df: DataFrame, columns: Sequence[str], types, counted: bool = False) -> DataFrame:
    """Distinct non-null (column index, value) pairs of all ``columns`` from one
    stacked pass with partial aggregation.  ``v`` is the text form (the
    join / map key); ``d`` and ``l`` carry the numeric order for numeric
    columns (``l`` exact for integral types, ``d`` for the others).
    ``counted`` adds the rows of each value as ``n``."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), _present(c, types[c]).cast("string").alias("v"),
                 (_present(c, types[c]).cast("double") if isinstance(types[c], _NUMERIC) else F.lit(None).cast("double")).alias("d"),
                 (_present(c, types[c]).cast("bigint") if isinstance(types[c], _INTEGRAL)
                  else F.lit(None).cast("bigint")).alias("l"))
        for i, c in enumerate(columns)])).alias("s")).select("s.*").where(F.col("v").isNotNull())
    return stacked.groupBy("i", "v", "d", "l").agg(F.count(F.lit(1)).alias("n")) if counted else stacked.distinct()


def _category_rows(distinct: DataFrame, columns: Sequence[str], types, wanted) -> dict[str, list]:
    """Collect the (bounded) distinct values of the columns indexed by ``wanted``
    as sorted Python lists of (value, rows); rows are 0 where they were not counted."""
    out: dict[str, list] = {columns[i]: [] for i in wanted}
    if not wanted:
        return out
    counted = "n" in distinct.columns
    for r in distinct.where(F.col("i").isin(list(wanted))).collect():
        c = columns[r["i"]]
        dt = types[c]
        if isinstance(dt, T.BooleanType):
            value = r["v"] == "true"
        elif isinstance(dt, _NUMERIC):
            value = r["l"] if r["l"] is not None else r["d"]
        else:
            value = r["v"]
        out[c].append((value, r["n"] if counted else 0))
    return {c: sorted(v, key=lambda x: _sort_key(x[0])) for c, v in out.items()}


def _category_lists(distinct: DataFrame, columns: Sequence[str], types, wanted) -> dict[str, list]:
    return {c: [v for v, _ in rows] for c, rows in _category_rows(distinct, columns, types, wanted).items()}


def fit_categories(df: DataFrame, columns: Sequence[str], max_categories: int = 10_000) -> dict[str, list]:
    """Sorted distinct non-null values per column (numeric columns sort by
    value, so 2 < 10).  One distinct job over (column, value) pairs; more
    than ``max_categories`` values in a column is an error.  The callers
    (one-hot dummies, tree bins) produce one output column or bin per
    category, so the cap bounds their output width, not the rows read;
    label encoding has no such bound and uses ``fit_label_encoder``."""
    if not columns:
        return {}
    types = _types(df)
    distinct = _distinct_values(df, columns, types)
    counts = {r["i"]: r["n"] for r in distinct.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    too_many = [columns[i] for i, n in counts.items() if n > max_categories]
    if too_many:
        raise ValueError(f"more than {max_categories} categories in {too_many}")
    return _category_lists(distinct, columns, types, range(len(columns)))


# Columns with more distinct values than this, or more value bytes, are
# label-encoded through a distributed dictionary table instead of a literal
# map in the plan (long texts would make the plan itself large).
LITERAL_CATEGORIES = 100
LITERAL_BYTES = 1 << 20
# Dictionaries up to this many rows and this many value bytes (both
# measured at fit) are broadcast to the rows they encode.
DICTIONARY_BROADCAST_ROWS = 1_000_000
DICTIONARY_BROADCAST_BYTES = 64 << 20


@dataclass
class LabelEncoderModel:
    """L3: value -> position in the sorted category list; NULL and unseen
    values stay NULL (or take ``unseen_code``).

    ``categories`` holds the lists of columns with at most
    ``LITERAL_CATEGORIES`` values (applied as a literal map, no join).
    ``dictionaries`` holds, for wider columns, a checkpointed table
    (``value`` text, ``code`` int) applied with a left join; ``dictionary_rows``
    and ``dictionary_bytes`` are its size (rows, total value bytes), measured
    at fit, which decide broadcast versus shuffle join."""
    categories: dict[str, list] = field(default_factory=dict)
    unseen_code: int | None = None
    dictionaries: dict[str, DataFrame] = field(default_factory=dict)
    dictionary_rows: dict[str, int] = field(default_factory=dict)
    dictionary_bytes: dict[str, int] = field(default_factory=dict)
    counts: dict[str, list[int]] = field(default_factory=dict)  # of a counted fit: rows of each of ``categories``

    def _broadcastable(self, c: str) -> bool:
        rows = self.dictionary_rows.get(c)
        size = self.dictionary_bytes.get(c)
        return (rows is not None and size is not None and rows <= DICTIONARY_BROADCAST_ROWS
                and size <= DICTIONARY_BROADCAST_BYTES)

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        types = _types(df)
        exprs = {}
        for c, cats in self.categories.items():
            m = F.create_map(*[x for i, v in enumerate(cats) for x in (F.lit(v), F.lit(i))]) if cats else None
            exprs[c] = F.element_at(m, category_key(c, types[c])) if m is not None else F.lit(None)
        out = df
        for j, (c, table) in enumerate(self.dictionaries.items()):
            key, code = f"__lek{j}", f"__lec{j}"
            lookup = table.select(F.col("value").alias(key), F.col("code").alias(code))
            if self._broadcastable(c):
                lookup = F.broadcast(lookup)
            # a hot value is one skewed join key: AQE splits it (left side)
            out = out.withColumn(key, _present(c, types[c]).cast("string")).join(lookup, key, "left")
            exprs[c] = F.col(code)
        for c, code in exprs.items():
            if self.unseen_code is not None:
                code = F.when(F.col(f"`{c}`").isNotNull(), F.coalesce(code, F.lit(self.unseen_code)))
            wide = self.dictionary_rows.get(c, 0) >= 1 << 31
            exprs[c] = code.cast("bigint" if wide else "int").alias(c + suffix)
        if suffix:
            return out.select(*[F.col(f"`{c}`") for c in df.columns], *exprs.values())
        return out.select(*[exprs.get(c, F.col(f"`{c}`")) for c in df.columns])

    def to_json(self) -> str:
        if self.dictionaries:
            raise ValueError("dictionary-encoded columns are tables: use save(path)")
        return json.dumps({"categories": self.categories, "unseen_code": self.unseen_code}, default=str)

    def save(self, path: str) -> None:
        """Literal lists as JSON, each dictionary as a Parquet table."""
        spark = next(iter(self.dictionaries.values())).sparkSession if self.dictionaries else None
        meta = {"categories": self.categories, "unseen_code": self.unseen_code,
                "dictionaries": {c: f"dict{j}" for j, c in enumerate(self.dictionaries)},
                "dictionary_rows": self.dictionary_rows, "dictionary_bytes": self.dictionary_bytes}
        for j, table in enumerate(self.dictionaries.values()):
            table.write.mode("overwrite").parquet(f"{path}/dict{j}")
        if spark is None:
            from pyspark.sql import SparkSession
            spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1).write.mode(
            "overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> "LabelEncoderModel":
        meta = json.loads(spark.read.text(f"{path}/meta").collect()[0][0])
        tables = {c: spark.read.parquet(f"{path}/{name}") for c, name in meta["dictionaries"].items()}
        return LabelEncoderModel(meta["categories"], meta["unseen_code"], tables,
                                 {c: int(n) for c, n in meta["dictionary_rows"].items()},
                                 {c: int(n) for c, n in meta.get("dictionary_bytes", {}).items()})


def _fit_dictionaries(distinct: DataFrame, wide: Sequence[int], n_values: int, types,
                      columns: Sequence[str]) -> DataFrame:
    """Exact 0-based code of every distinct value of the ``wide`` columns in
    sorted order (numbers by value), all columns numbered together by the
    skew-safe ranged ``rank_within`` grouped by column (no single task sees
    all values), and checkpointed into the shared checkpoint folder, so
    scoring reads fixed data.  Rows: (i, value, code)."""
    from ..operators.order import rank_within
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(distinct.sparkSession)
    numeric = [i for i in wide if isinstance(types[columns[i]], _NUMERIC)]
    # text columns order by the text; numeric ones by value (l exact for
    # integers, d otherwise), with the text only as a final tiebreak
    vals = distinct.where(F.col("i").isin(list(wide))).select(
        "i", "v", F.when(F.col("i").isin(numeric), F.col("l")).alias("l"),
        F.when(F.col("i").isin(numeric), F.col("d")).alias("d"), *[n for n in distinct.columns if n == "n"])
    ranked = rank_within(vals, ["i"], ["l", "d", "v"], name="__r", n_rows=n_values)
    table = ranked.select("i", F.col("v").alias("value"), (F.col("__r") - 1).cast("bigint").alias("code"), *[n for n in distinct.columns if n == "n"])
    return table.checkpoint(eager=True)


def fit_label_encoder(df: DataFrame, columns: Sequence[str], unseen_code: int | None = None,
                      literal_limit: int | None = None, counted: bool = False) -> LabelEncoderModel:
    """L3 fit: one distinct job over all columns.  Columns with at most
    ``literal_limit`` values become literal maps; wider ones get an exact
    dictionary table (no cap on the number of categories).  ``counted`` adds each
    value's rows: ``counts`` of literal lists, a column ``n`` of dictionaries."""
    limit = LITERAL_CATEGORIES if literal_limit is None else literal_limit
    columns = list(columns)
    if not columns:
        return LabelEncoderModel({}, unseen_code)
    types = _types(df)
    distinct = _distinct_values(df, columns, types, counted).persist()
    try:
        sized = distinct.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("v")).alias("b"))
        counts, nbytes = {}, {}
        for r in sized.collect():
            counts[r["i"]], nbytes[r["i"]] = r["n"], r["b"] or 0
        small = [i for i in range(len(columns))
                 if counts.get(i, 0) <= limit and nbytes.get(i, 0) <= LITERAL_BYTES]
        found = _category_rows(distinct, columns, types, small)
        cats = {c: [v for v, _ in rows] for c, rows in found.items()}
        dicts, sizes, byte_sizes = {}, {}, {}
        wide = [i for i in range(len(columns)) if i not in small]
        if wide:
            table = _fit_dictionaries(distinct, wide, sum(counts[i] for i in wide), types, columns)
            for i in wide:
                dicts[columns[i]] = table.where(F.col("i") == i).drop("i")
                sizes[columns[i]] = int(counts[i])
                byte_sizes[columns[i]] = int(nbytes[i])
        ordered = {c: cats[c] for c in columns if c in cats}
        return LabelEncoderModel(ordered, unseen_code, dicts, sizes, byte_sizes,
                                 {c: [n for _, n in rows] for c, rows in found.items()} if counted else {})
    finally:
        distinct.unpersist()


def _dummy_name(c: str, v) -> str:
    if isinstance(v, float) and v.is_integer():
        v = v
    if isinstance(v, bool):
        v = str(v)
    return f"{c}_{v}"


@dataclass
class OneHotModel:
    """One 0/1 double column ``<col>_<value>`` per category except the
    first (drop_first); NULL and unseen values give all zeros."""
    categories: dict[str, list] = field(default_factory=dict)
    drop_first: bool = True

    def output_columns(self) -> list[str]:
        cols = []
        for c, cats in self.categories.items():
            kept = cats[1:] if self.drop_first else cats
            cols += [_dummy_name(c, v) for v in kept]
        return cols

    def transform(self, df: DataFrame) -> DataFrame:
        """Categorical columns are replaced by their dummies, which are placed
        after the remaining columns (the pandas ``get_dummies`` layout)."""
        keep = [F.col(f"`{c}`") for c in df.columns if c not in self.categories]
        dummies = []
        for c, cats in self.categories.items():
            kept = cats[1:] if self.drop_first else cats
            for v in kept:
                dummies.append(F.when(F.col(f"`{c}`") == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0))
                               .alias(_dummy_name(c, v)))
        return df.select(*keep, *dummies)


def fit_one_hot(df: DataFrame, columns: Sequence[str], drop_first: bool = True, max_categories: int = 10_000) -> OneHotModel:
    return OneHotModel(fit_categories(df, columns, max_categories), drop_first)


@dataclass
class ScalerModel:
    """(x - mean) / population deviation; a zero deviation scales by 1."""
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = {}
        for c, m in self.means.items():
            s = self.stds.get(c) or 1.0
            exprs[c] = ((F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s)).alias(c)
        return df.select(*[exprs.get(c, F.col(f"`{c}`")) for c in df.columns])


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> ScalerModel:
    """Means and population deviations of all columns in one aggregate."""
    cols = list(columns)
    if not cols:
        return ScalerModel()
    row = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]
                 ).collect()[0]
    means = {c: float(row[f"m{i}"]) if row[f"m{i}"] is not None else 0.0 for i, c in enumerate(cols)}
    stds = {}
    for i, c in enumerate(cols):
        s = row[f"s{i}"]
        stds[c] = float(s) if s not in (None, 0.0) and s == s else 1.0
    return ScalerModel(means, stds)


@dataclass
class LinearFeaturesModel:
    """State of ``prepare linear features``: chosen features, numeric
    columns treated as categories, dummy layout, training columns, scaler."""
    features: list[str]
    one_hot: OneHotModel
    train_columns: list[str]
    scaler: ScalerModel

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Apply the fitted state; ``keep`` columns (ids, target) pass through
        in front.  Scoring columns are aligned to the training columns (L6)."""
        from ..operators.sampling import align_columns
        x = df.select(*[F.col(f"`{c}`") for c in list(keep) + [c for c in self.features if c not in keep]])
        x = self.one_hot.transform(x)
        x = align_columns(x, list(keep) + self.train_columns, 0.0)
        return self.scaler.transform(x)

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "one_hot": asdict(self.one_hot),
                           "train_columns": self.train_columns, "scaler": asdict(self.scaler)}, default=str)

    @staticmethod
    def from_json(text: str) -> "LinearFeaturesModel":
        d = json.loads(text)
        return LinearFeaturesModel(d["features"], OneHotModel(**d["one_hot"]), d["train_columns"],
                                   ScalerModel(**d["scaler"]))


def fit_linear_features(df: DataFrame, features: Sequence[str],
                        numeric_categoricals: Sequence[str] = (), max_categories: int = 10_000) -> LinearFeaturesModel:
    """L8 fit: text / boolean features and ``numeric_categoricals`` become
    dummies (drop first), then every resulting column, dummies included, is
    standardised (L7)."""
    types = _types(df)
    feats = list(features)
    cats = [c for c in feats if c in numeric_categoricals or isinstance(types[c], (T.StringType, T.BooleanType))]
    oh = fit_one_hot(df, cats, drop_first=True, max_categories=max_categories)
    x = oh.transform(df.select(*[F.col(f"`{c}`") for c in feats]))
    train_cols = x.columns
    scaler = fit_scaler(x, train_cols)
    return LinearFeaturesModel(feats, oh, train_cols, scaler)
