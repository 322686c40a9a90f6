"""Order-dependent operators: P3 / P9 numbering, N6 / N7 fills, S5 detection.

pandas rows are ordered; Spark rows are not, and a window with an
``ORDER BY`` but no ``PARTITION BY`` moves the whole table into one task.
Every operator here instead works on *range buckets* of the ordering:

1. a bounded sample of the order tuple is sorted by Spark, by range, and
   every k-th tuple (long texts cut to their first characters) becomes a
   literal boundary (boundaries are fixed values in the plan, so a recomputed stage after a lost executor puts every row in the
   same bucket again);
2. each row gets its bucket from a binary search over one literal array of
   boundaries (log2 of the bucket count comparisons, all inside codegen);
3. the per-row work is an ordinary window *partitioned by the bucket*;
4. what crosses buckets (row counts, the last non-null value) is aggregated
   to one row per bucket, combined with a window over that small table and
   joined back.

Bucket keys are (partition keys, order columns, 64-bit hash of the whole
row), so ties in the user's ``order_by`` -- a hot key holding a third of the
rows -- are spread over many buckets; windows order by that key and then by
the rest of the row, so the result does not depend on partitioning.  Each
shuffle partition receives a run of consecutive, equally sized buckets
(placed by ``repartitionById``, no sampling pass).  Only
rows identical in every column cannot be split (they are interchangeable,
so the answer is still exact).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..session import default_parallelism

# Bucket count bounds.  Buckets are hashed to shuffle partitions, so there
# are several per partition to even out the load.
MAX_BUCKETS = 65536
BUCKETS_PER_PARTITION = 4
# Up to this many boundaries the search is a code-generated CASE tree;
# beyond it a constant-size higher-order loop.
CASE_SEARCH_LIMIT = 256
ROWS_PER_BUCKET = 2_000_000
SAMPLES_PER_BUCKET = 32
# Boundaries go to every task; long texts and binaries in them are cut to a leading part.
BOUNDARY_BYTES = 64 << 20
BOUNDARY_CHARS = 1024
# A sample of at most this many keys is ranked by one window, in one job; larger ones by range.
WINDOW_SAMPLE = 20_000
# Per-bucket / per-key carry tables up to this many rows are broadcast.
BROADCAST_ROWS = 1_000_000
ORDER_SEED = 17


def _fixed_width(dt: T.DataType) -> bool:
    """Values of this type take a bounded number of bytes."""
    return isinstance(dt, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _orderable(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType) or isinstance(dt, T.VariantType if hasattr(T, "VariantType") else ()):
        return False
    if isinstance(dt, T.ArrayType):
        return _orderable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(_orderable(f.dataType) for f in dt.fields)
    return True


def lead_columns(df: DataFrame, order_by: Sequence[str], keys: Sequence[str] = ()) -> list[str]:
    """keys, then the order columns (the row hash and the rest of the row
    follow as tiebreak, see ``Buckets``)."""
    lead = list(keys) + [c for c in order_by if c not in keys]
    missing = [c for c in lead if c not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s) {missing}")
    return lead


def _row_hash(df: DataFrame) -> Column:
    """Deterministic 64-bit hash of the whole row (the tiebreak inside the
    bucket key: equal hashes mean equal rows, barring collisions, which the
    window order then settles by the full row)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [F.col(f"`{c}`") for c in df.columns if _orderable(types[c])]
    return F.xxhash64(*cols) if cols else F.lit(0).cast("bigint")


class Buckets:
    """Range buckets of an ordering.

    ``apply(df)`` adds ``__b`` (bucket number, in order), ``__rowhash`` and
    ``__pkey`` and hash-partitions the rows on ``__pkey``: every shuffle
    partition receives a run of consecutive buckets of equal expected size,
    because ``__pkey`` is, per partition, an integer whose Murmur3 hash (the
    function Spark's hash partitioning applies) lands on that partition.
    Windows partitioned by ``partition_cols`` (+ keys) then need no further
    exchange, and no sampling pass is spent on range partitioning.
    ``key`` is the full window order: lead columns, row hash, rest of row.
    """

    partition_cols = ("__pkey", "__b")

    def __init__(self, lead: list[str], rest: list[str], bounds_df: DataFrame | None, m: int, partitions: int):
        self.lead, self.rest, self.bounds_df, self.m, self.partitions = lead, rest, bounds_df, m, partitions
        self.count = m + 1

    @property
    def key(self) -> Column:
        return F.struct(*[quoted(c).alias(f"f{i}") for i, c in enumerate(self.lead)], F.col("__rowhash").alias("h"),
                        *[quoted(c).alias(f"r{i}") for i, c in enumerate(self.rest)])

    def bucket_key(self) -> Column:
        return F.struct(*[quoted(c).alias(f"f{i}") for i, c in enumerate(self.lead)], F.col("__rowhash").alias("h"))

    def apply(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("__rowhash", _row_hash(df))
        if self.bounds_df is None:
            return out.withColumn("__b", F.lit(0)).withColumn("__pkey", F.lit(0))
        out = _search(out, self.bucket_key(), self.bounds_df.select("b").scalar(), self.m, "__b")
        parts = min(self.partitions, self.count)
        out = out.withColumn("__pkey", F.floor(F.col("__b") * F.lit(parts) / F.lit(self.count)).cast("int"))
        return out.repartitionById(parts, F.col("__pkey"))


def _search(df: DataFrame, key: Column, bounds: Column, m: int, out: str) -> DataFrame:
    """Add ``out`` = number of the ``m`` sorted boundaries that are <= key.

    Binary search by binary lifting, written as one higher-order
    ``aggregate`` over the step sizes (m/2, ..., 2, 1): log2(m) comparisons
    per row against ``try_element_at`` of the boundary array, which arrives
    as a scalar subquery over a one-row local table (evaluated once per
    query, no join).  The expression has constant size for any bucket count."""
    steps = []
    step = 1
    while step * 2 <= m:
        step *= 2
    while step >= 1:
        steps.append(step)
        step //= 2

    def lift(acc, st):
        cand = acc + st
        return F.when((cand <= F.lit(m)) & (F.try_element_at(F.col("__bounds"), cand) <= F.col("__key")),
                      cand).otherwise(acc)

    cur = df.withColumn("__key", key).withColumn("__bounds", bounds)
    if m <= CASE_SEARCH_LIMIT:
        # small bucket counts: a balanced CASE tree over the same array,
        # fully code-generated (2m nodes, log2(m) comparisons per row)
        def tree(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(F.col("__key") < F.element_at(F.col("__bounds"), mid + 1), tree(lo, mid)).otherwise(
                tree(mid + 1, hi))
        cur = cur.withColumn(out, tree(0, m))
    else:
        cur = cur.withColumn(out, F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lift))
    return cur.drop("__key", "__bounds")


def _cut(sample: DataFrame, n_buckets: int) -> DataFrame:
    """Sampled keys with long texts and binaries cut to their first characters.

    Any point of the key's order may be a boundary, and a leading part is one, just before
    the whole, so buckets stay in order and exact.  Rows that share that many leading
    characters (and are equal in the columns before) share a bucket."""
    chars = max(16, min(BOUNDARY_CHARS, BOUNDARY_BYTES // (4 * n_buckets)))
    key = sample.schema["__t"].dataType
    parts = [F.substring(F.col("__t")[f.name], 1, chars) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.col("__t")[f.name] for f in key.fields]
    return sample.select(F.struct(*[p.alias(f.name) for p, f in zip(parts, key.fields)]).alias("__t"))


def _every_kth(sample: DataFrame, k: int) -> DataFrame:
    """Every k-th key of a sample, in order.  Spark sorts the sample by range, and a key's
    rank is its place in its partition after the rows of the partitions before, of which
    only the counts reach the driver: no task sees the whole sample."""
    ordered = sample.orderBy("__t").select("__t", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")).persist()
    try:
        before, total = {}, 0
        for r in ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("first")).orderBy("__p").collect():
            before[r["__p"]] = total - r["first"]
            total += r["n"]
        if not before:
            return ordered.select("__t").limit(0)
        shift = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("__p"))
        rows = ordered.where((F.col("__m") + shift + 1) % k == 0).orderBy("__t").select("__t").collect()
        return sample.sparkSession.createDataFrame(rows, ordered.select("__t").schema)
    finally:
        ordered.unpersist()


def range_buckets(df: DataFrame, lead: Sequence[str], n_rows: int | None = None,
                  n_buckets: int | None = None) -> Buckets:
    """Range buckets over (lead columns, row hash), boundaries from a bounded
    sample: Spark sorts about SAMPLES_PER_BUCKET sampled keys per bucket and
    only every k-th key reaches the driver.  The boundaries go back as a
    one-row local table, so a recomputed stage buckets every row the same
    way again."""
    spark = df.sparkSession
    lead = list(lead)
    types = {f.name: f.dataType for f in df.schema.fields}
    rest = [c for c in df.columns if c not in lead and _orderable(types[c])]
    parts = default_parallelism(spark)
    if n_rows is None:
        n_rows = df.count()
    if n_buckets is None:
        n_buckets = max(BUCKETS_PER_PARTITION * parts, math.ceil(n_rows / ROWS_PER_BUCKET))
    n_buckets = int(max(1, min(n_buckets, MAX_BUCKETS)))
    if n_rows == 0 or n_buckets == 1:
        return Buckets(lead, rest, None, 0, parts)
    want = n_buckets * SAMPLES_PER_BUCKET
    fraction = min(1.0, 1.5 * want / n_rows)
    hashed = df.withColumn("__rowhash", _row_hash(df))
    bkey = F.struct(*[quoted(c).alias(f"f{i}") for i, c in enumerate(lead)], F.col("__rowhash").alias("h"))
    sample = hashed.select(bkey.alias("__t"))
    if fraction < 1.0:
        sample = sample.sample(False, fraction, ORDER_SEED)
    m = min(n_rows, want) if fraction >= 1.0 else want
    step, keys = max(1, math.ceil(m / n_buckets)), _cut(sample, n_buckets)
    if 2 * want <= WINDOW_SAMPLE:  # half as many again are drawn
        ranked = keys.withColumn("__r", F.row_number().over(Window.orderBy("__t")))
        picked = ranked.where((F.col("__r") % step) == 0).orderBy("__r").select("__t")
    else:
        picked = _every_kth(keys, step)
    struct_type = picked.schema["__t"].dataType
    seen = []
    for r in picked.collect():
        if not seen or seen[-1] != r["__t"]:
            seen.append(r["__t"])
    if not seen:
        return Buckets(lead, rest, None, 0, parts)
    bounds_df = spark.createDataFrame([(seen,)], T.StructType([T.StructField("b", T.ArrayType(struct_type))]))
    return Buckets(lead, rest, bounds_df, len(seen), parts)


# ... and up to this many bytes (measured or bounded by type).
BROADCAST_BYTES = 64 << 20


def _join_carry(rows: DataFrame, carry: DataFrame, on: list[str], carry_rows: int,
                carry_bytes: int) -> DataFrame:
    if carry_rows <= BROADCAST_ROWS and carry_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(carry), on, "left")
    return rows.join(carry, on, "left")


def add_row_index(df: DataFrame, order_by: Sequence[str] | None = None, name: str = "Index",
                  start: int = 1, n_buckets: int | None = None) -> DataFrame:
    """Insert a dense 1..n (or ``start``..) column at position 0.

    ``order_by=None`` numbers rows in file order (the DataFrame must be a
    file scan); otherwise rows are numbered by ``order_by`` with the rest of
    the row as tiebreak.  Raises if ``name`` already exists (D23).
    """
    if name in df.columns:
        raise ValueError(f"cannot insert {name!r}: a column with that name already exists")
    if order_by is None:
        return _add_file_order_index(df, name, start)
    bk = range_buckets(df, lead_columns(df, order_by), None, n_buckets)
    b = bk.apply(df)
    key, nb = bk.key, bk.count
    # One row per bucket; offsets are a prefix sum over that small table.
    sizes = b.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    offsets = sizes.select("__b", (F.sum("__c").over(
        Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).alias("__off"))
    offsets = offsets.fillna(0, ["__off"])
    numbered = b.withColumn("__p", F.row_number().over(Window.partitionBy(*bk.partition_cols).orderBy(key)))
    # offsets has one row per bucket (bounded by MAX_BUCKETS): broadcast it.
    # Both branches read the same range exchange of ``b`` in one query.
    joined = numbered.join(F.broadcast(offsets), ["__b"], "left")
    out = joined.withColumn(name, (F.col("__off") + F.col("__p") + F.lit(start - 1)).cast("bigint"))
    return out.select(name, *df.columns)


def _add_file_order_index(df: DataFrame, name: str, start: int) -> DataFrame:
    """Number rows in file order using the scan's hidden ``_metadata`` column.

    Blocks are file splits: a row's position inside its block comes from
    ``monotonically_increasing_id`` (contiguous inside a split), so rows are
    never shuffled; only one row per block is aggregated and joined back.
    """
    try:
        marked = df.select("*", F.col("_metadata.file_path").alias("__fp"),
                           F.col("_metadata.file_block_start").alias("__fs"),
                           F.monotonically_increasing_id().alias("__m"))
    except Exception as exc:  # not a file scan
        raise ValueError("file-order numbering needs a DataFrame read from files; pass order_by") from exc
    blocks = marked.groupBy("__fp", "__fs").agg(F.count(F.lit(1)).alias("__c"), F.min("__m").alias("__m0"))
    blocks = blocks.persist()
    size = blocks.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("__fp")).alias("w")).collect()[0]
    n_blocks = size["n"]
    # per block: the path, the split start, the first id and the offset
    offsets = blocks.select("__fp", "__fs", "__m0", F.coalesce(F.sum("__c").over(
        Window.orderBy("__fp", "__fs").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    joined = _join_carry(marked, offsets, ["__fp", "__fs"], n_blocks, n_blocks * ((size["w"] or 0) + 24))
    out = joined.withColumn(name, (F.col("__off") + F.col("__m") - F.col("__m0") + F.lit(start)).cast("bigint"))
    return out.select(name, *df.columns)


def sort_for_files(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Rows so that files written from them are in order: a range sort, part file by part file."""
    return df.orderBy(*map(quoted, lead_columns(df, order_by)))


def reset_row_index(df: DataFrame, order_by: Sequence[str] | None = None, name: str = "index",
                    drop: Sequence[str] = ()) -> DataFrame:
    """Drop old label columns and number rows again from 0."""
    base = df.drop(*drop) if drop else df
    return add_row_index(base, order_by=order_by, name=name, start=0)


def _join_buckets(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of a per-(bucket, key) table; a NULL key is a key like any other."""
    table = table.withColumnRenamed("__b", "__at")
    same = F.col("__b") == F.col("__at")
    for i, c in enumerate(keys):
        same = same & quoted(c).eqNullSafe(F.col(f"__of{i}"))
    return rows.join(table, same, "left")


def fill_ordered(df: DataFrame, columns: Sequence[str], order_by: Sequence[str],
                 direction: str = "forward", partition_by: Sequence[str] = (),
                 n_buckets: int | None = None) -> DataFrame:
    """Fill NULLs from the previous (forward) or next (backward)
    non-null value along ``order_by``, optionally within ``partition_by``.

    The buckets range over (keys, order, rest), so a key holding a third of
    the table is spread over many tasks; the value carried into a bucket is
    the last (first) non-null value of the same key in earlier (later)
    buckets, computed on a table with one row per (bucket, key).
    """
    if direction not in ("forward", "backward"):
        raise ValueError("direction must be 'forward' or 'backward'")
    cols = list(columns)
    keys = list(partition_by)
    types = {f.name: f.dataType for f in df.schema.fields}

    def _known(c: str) -> Column:
        """The value, NaN counting as missing."""
        return F.when(~F.isnan(quoted(c)), quoted(c)) if isinstance(types[c], (T.FloatType, T.DoubleType)) else quoted(c)

    bk = range_buckets(df, lead_columns(df, order_by, keys), None, n_buckets)
    b = bk.apply(df)
    key = bk.key
    fwd = direction == "forward"
    # Backward runs the order from its end: a frame that reaches to the last row would be
    # summed up anew for every row of the bucket.
    w = Window.partitionBy(*bk.partition_cols, *keys).orderBy(key.asc() if fwd else key.desc())
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    local = b.select("*", *[F.last(_known(c), ignorenulls=True).over(w).alias(f"__l{i}")
                            for i, c in enumerate(cols)])

    # Edge value of every (bucket, key): last (first) non-null along the order.
    edge_agg = F.max_by if fwd else F.min_by
    edges = b.groupBy("__b", *keys).agg(*[
        edge_agg(_known(c), F.when(_known(c).isNotNull(), key)).alias(f"__e{i}") for i, c in enumerate(cols)])
    wc = Window.partitionBy(*keys).orderBy(F.asc("__b") if fwd else F.desc("__b"))
    wc = wc.rowsBetween(Window.unboundedPreceding, -1)
    # Buckets are ordered by key, so only the key a bucket shares with its
    # neighbour can carry a value in: one row per bucket (at most
    # MAX_BUCKETS), whatever the number of keys.  When its columns are
    # fixed-width its bytes are bounded too and it is broadcast; with long
    # text, AQE picks a broadcast from its runtime size or keeps the shuffle
    # join (skew-join handling on).
    carry = edges.select("__b", *[quoted(c).alias(f"__of{i}") for i, c in enumerate(keys)], F.count(F.lit(1)).over(wc).alias("__before"),
                         *[F.last(F.col(f"__e{i}"), ignorenulls=True).over(wc).alias(f"__k{i}") for i in range(len(cols))])
    carry = carry.where("__before > 0").drop("__before")
    bounded = all(_fixed_width(types[c]) for c in [*cols, *keys])
    joined = _join_buckets(local, F.broadcast(carry) if bounded else carry, keys)
    filled = {c: F.coalesce(_known(c), F.col(f"__l{i}"), F.col(f"__k{i}")).alias(c) for i, c in enumerate(cols)}
    return joined.select(*[filled.get(c, quoted(c)) for c in df.columns])


def sequential_index_report(df: DataFrame, columns: Sequence[str], order_by: Sequence[str],
                            n_buckets: int | None = None) -> DataFrame:
    """Per column, is it numeric, its first value along the order,
    whether it never decreases, and whether it qualifies as a row index
    (numeric, non-decreasing, first value 0 or 1; D16: the intended rule).

    One row per column: column, first_value, is_monotonic, is_index.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    bk = range_buckets(df, lead_columns(df, order_by), None, n_buckets)
    b = bk.apply(df)
    key = bk.key
    w = Window.partitionBy(*bk.partition_cols).orderBy(key)
    numeric = [c for c in columns if isinstance(types[c], (T.ByteType, T.ShortType, T.IntegerType,
                                                           T.LongType, T.FloatType, T.DoubleType,
                                                           T.DecimalType))]
    # Inside a bucket: a decrease against the previous row.  Across buckets:
    # first row of a bucket against the last row of the previous bucket.
    flagged = b.select("__b", key.alias("__t"), *[
        (quoted(c) < F.lag(quoted(c)).over(w)).alias(f"__d{i}") for i, c in enumerate(numeric)],
        *[quoted(c).alias(f"__v{i}") for i, c in enumerate(numeric)])
    per_bucket = flagged.groupBy("__b").agg(
        *[F.sum(F.col(f"__d{i}").cast("int")).alias(f"__x{i}") for i in range(len(numeric))],
        *[F.min_by(F.col(f"__v{i}"), F.col("__t")).alias(f"__f{i}") for i in range(len(numeric))],
        *[F.max_by(F.col(f"__v{i}"), F.col("__t")).alias(f"__z{i}") for i in range(len(numeric))])
    wb = Window.orderBy("__b")
    summary = per_bucket.select("__b", *[
        F.struct(F.col(f"__x{i}").alias("x"), F.col(f"__f{i}").alias("f"),
                 (F.col(f"__f{i}") < F.lag(F.col(f"__z{i}")).over(wb)).alias("cross")).alias(f"__s{i}")
        for i in range(len(numeric))])
    rows = []
    if numeric:
        agg = summary.agg(*[F.struct(
            (F.coalesce(F.sum(F.col(f"__s{i}.x")), F.lit(0)) + F.coalesce(
                F.sum(F.col(f"__s{i}.cross").cast("int")), F.lit(0)) == 0).alias("mono"),
            F.min_by(F.col(f"__s{i}.f"), F.col("__b")).cast("double").alias("first")).alias(f"r{i}")
            for i in range(len(numeric))]).collect()[0]
        for i, c in enumerate(numeric):
            r = agg[f"r{i}"]
            rows.append((c, r["first"], bool(r["mono"]),
                         bool(r["mono"]) and r["first"] in (0.0, 1.0)))
    for c in columns:
        if c not in numeric:
            rows.append((c, None, False, False))
    order = {c: i for i, c in enumerate(columns)}
    rows.sort(key=lambda r: order[r[0]])
    return df.sparkSession.createDataFrame(
        rows, "column string, first_value double, is_monotonic boolean, is_index boolean")


def rank_within(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], name: str = "rank",
                size_name: str | None = None, n_buckets: int | None = None,
                n_rows: int | None = None) -> DataFrame:
    """1-based dense position of every row inside its ``keys`` group along
    ``order_by`` (``row_number() over (partition by keys order by ...)``),
    and optionally the group size.

    Skew-safe: the buckets range over (keys, order, rest), so one group
    holding a third of the rows is numbered by many tasks; the offset of a
    bucket inside its group is a prefix sum on a table with one row per
    (bucket, key).  ``n_rows`` (the row count, when the caller knows it)
    saves the counting job.
    """
    keys = list(keys)
    bk = range_buckets(df, lead_columns(df, order_by, keys), n_rows, n_buckets)
    b = bk.apply(df)
    key = bk.key
    local = b.withColumn("__p", F.row_number().over(Window.partitionBy(*bk.partition_cols, *keys).orderBy(key)))
    sizes = b.groupBy("__b", *keys).agg(F.count(F.lit(1)).alias("__c"))
    wk = Window.partitionBy(*keys).orderBy("__b")
    offs = sizes.select("__b", *[quoted(c).alias(f"__of{i}") for i, c in enumerate(keys)],
                        F.sum("__c").over(wk.rowsBetween(Window.unboundedPreceding, -1)).alias("__off"),
                        F.sum("__c").over(Window.partitionBy(*keys)).alias("__size"))
    if not size_name:
        # only the key a bucket shares with the one before has an offset: one row per bucket
        offs = offs.where("__off IS NOT NULL")
        types = {f.name: f.dataType for f in df.schema.fields}
        offs = F.broadcast(offs) if all(_fixed_width(types[c]) for c in keys) else offs
    joined = _join_buckets(local, F.broadcast(offs) if not keys else offs, keys)
    extra = [(F.coalesce("__off", F.lit(0)) + F.col("__p")).cast("bigint").alias(name)]
    if size_name:
        extra.append(F.col("__size").cast("bigint").alias(size_name))
    return joined.select(*map(quoted, df.columns), *extra)
