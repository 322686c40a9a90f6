"""Registered queries: one per operator of the inventory, each with the
DuckDB SQL that must give the same rows.

Test tables hold no NULLs, so both sides mask values with the same fixed
rule (``mask``).  Doubles are rounded to 6 decimals on both sides, counts
are bigint and every computed column is aliased to the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import casts
from ..functions.names import quoted
from ..ml import evaluate
from ..operators import clean, order, profile, reshape, sampling
from ..session import scratch_path
from ..sources import catalog, files
from . import load
from .prep import PrepPlan, apply_casts, apply_plan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

R = 6  # decimals kept for doubles on both sides


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def rnd(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), R).alias(name or (c if isinstance(c, str) else None))


def mask(c: str, cond: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(F.col(c)).alias(c)


def lineitem_masked(spark, d) -> DataFrame:
    """l_discount / l_extendedprice / l_quantity NULL on every 5th line
    number; l_returnflag NULL when l_orderkey % 11 = 0; l_tax NULL when
    l_orderkey % 3 = 0."""
    li = table(spark, d, "lineitem")
    lm = F.col("l_linenumber") % 5 == 0
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        mask("l_quantity", lm), mask("l_extendedprice", lm), mask("l_discount", lm),
        mask("l_tax", F.col("l_orderkey") % 3 == 0),
        mask("l_returnflag", F.col("l_orderkey") % 11 == 0), "l_linestatus", "l_shipdate")


LINEITEM_MASKED_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_tax END AS l_tax,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
  l_linestatus, l_shipdate FROM lineitem)"""


def events_masked(spark, d) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.withColumn("value", F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")))


EVENTS_MASKED_SQL = """(SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props FROM events)"""


def orders_masked(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus",
                    mask("o_totalprice", F.col("o_orderkey") % 7 == 0), "o_orderdate",
                    mask("o_orderpriority", F.col("o_orderkey") % 5 == 0))


ORDERS_MASKED_SQL = """(SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders)"""


def _hash_sql(key: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(md5('{seed}' || '|' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"


# ---------------------------------------------------------------- projections

@register("select_features", "SELECT p_partkey, p_size, p_retailprice FROM part")
def q_select_features(spark, d):
    return reshape.select_columns(table(spark, d, "part"), ["p_partkey", "p_size", "p_retailprice"])


@register("drop_first_col", "SELECT p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def q_drop_first_col(spark, d):
    return reshape.drop_first_column(table(spark, d, "part"))


@register("drop_columns", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def q_drop_columns(spark, d):
    return reshape.drop_columns(table(spark, d, "part"), ["p_name", "p_type"])


@register("derived_column", f"""SELECT l_orderkey, l_linenumber,
  round(l_quantity * l_extendedprice * (1 - l_discount), {R}) AS sales FROM lineitem""")
def q_derived_column(spark, d):
    li = reshape.with_derived(table(spark, d, "lineitem"), "sales",
                              "l_quantity * l_extendedprice * (1 - l_discount)")
    return li.select("l_orderkey", "l_linenumber", rnd("sales"))


@register("map_labels", """SELECT o_orderkey, o_orderstatus,
  CASE o_orderstatus WHEN 'F' THEN 'fulfilled' WHEN 'O' THEN 'open' ELSE 'other' END AS status_label
  FROM orders""")
def q_map_labels(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return reshape.map_labels(o, "o_orderstatus", {"F": "fulfilled", "O": "open"}, "status_label",
                              default="other")


# ---------------------------------------------------------------- order

@register("add_row_index", """SELECT row_number() OVER (ORDER BY o_orderkey) AS "Index", *
  FROM orders""")
def q_add_row_index(spark, d):
    return order.add_row_index(table(spark, d, "orders"), ["o_orderkey"])


@register("reset_row_index", """SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS "index",
  o_orderkey, o_orderdate, o_totalprice FROM orders""")
def q_reset_row_index(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return order.reset_row_index(o, ["o_orderdate", "o_orderkey"])


@register("seq_index_detect", """WITH t AS (
  SELECT o_orderkey, o_custkey, o_totalprice,
    lag(o_orderkey) OVER w AS lk, lag(o_custkey) OVER w AS lc, lag(o_totalprice) OVER w AS lt,
    row_number() OVER w AS rn
  FROM orders WINDOW w AS (ORDER BY o_orderkey)),
s AS (
  SELECT 'o_orderkey' AS "column", CAST(max(CASE WHEN rn = 1 THEN o_orderkey END) AS DOUBLE) AS first_value,
         coalesce(bool_and(o_orderkey >= lk), true) AS is_monotonic FROM t
  UNION ALL
  SELECT 'o_custkey', CAST(max(CASE WHEN rn = 1 THEN o_custkey END) AS DOUBLE),
         coalesce(bool_and(o_custkey >= lc), true) FROM t
  UNION ALL
  SELECT 'o_totalprice', CAST(max(CASE WHEN rn = 1 THEN o_totalprice END) AS DOUBLE),
         coalesce(bool_and(o_totalprice >= lt), true) FROM t)
SELECT "column", first_value, is_monotonic, is_monotonic AND first_value IN (0, 1) AS is_index FROM s
UNION ALL SELECT 'o_orderstatus', CAST(NULL AS DOUBLE), false, false""")
def q_seq_index_detect(spark, d):
    o = table(spark, d, "orders")
    return order.sequential_index_report(o, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"],
                                         ["o_orderkey"])


# ---------------------------------------------------------------- sources

@register("empty_lead_col", "SELECT * FROM nation")
def q_empty_lead_col(spark, d):
    n = table(spark, d, "nation")
    with_blank = n.select(F.lit(None).cast("string").alias(""), *n.columns)
    return files.drop_empty_lead_column(with_blank)[0]


def _infer_sql(cols):
    parts = []
    for c in cols:
        v = f"trim(CAST({c} AS VARCHAR))"
        parts.append(f"""SELECT '{c}' AS "column", CASE
  WHEN count({v}) = 0 THEN 'double'
  WHEN bool_and(regexp_full_match({v}, '[+-]?[0-9]+')) THEN 'bigint'
  WHEN bool_and(TRY_CAST({v} AS DOUBLE) IS NOT NULL) THEN 'double'
  WHEN bool_and({v} IN ('True', 'TRUE', 'true', 'False', 'FALSE', 'false')) THEN 'boolean'
  ELSE 'string' END AS inferred_type FROM part""")
    return "\nUNION ALL\n".join(parts)


_PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@register("infer_types", _infer_sql(_PART_COLS))
def q_infer_types(spark, d):
    p = table(spark, d, "part")
    as_text = p.select(*[F.col(c).cast("string").alias(c) for c in p.columns])
    inferred = files.infer_types(as_text)
    return spark.createDataFrame([(c, inferred[c]) for c in p.columns], "column string, inferred_type string")


_SUMMARY_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels"]


@register("dataset_summary", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS name, CAST(count(*) AS BIGINT) AS \"rows\", "
    f"CAST((SELECT count(*) FROM (DESCRIBE {t})) AS BIGINT) AS \"columns\" FROM {t}" for t in _SUMMARY_TABLES))
def q_dataset_summary(spark, d):
    return catalog.dataset_summary({t: table(spark, d, t) for t in _SUMMARY_TABLES}).drop("task")


@register("validate_dataset", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS name, (SELECT count(*) FROM (SELECT 1 FROM {t} LIMIT 10)) >= 10 "
    f"AND (SELECT count(*) FROM (DESCRIBE {t})) >= 2 AS valid" for t in _SUMMARY_TABLES))
def q_validate_dataset(spark, d):
    return spark.createDataFrame([(t, profile.validate_dataset(table(spark, d, t))) for t in _SUMMARY_TABLES], "name string, valid boolean")


@register("csv_roundtrip", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  o_orderkey || 'D' AS code, 'say "' || o_orderstatus || '", ' || o_orderpriority || chr(10) || 'next, line' AS note FROM orders""")
def q_csv_roundtrip(spark, d):
    """S7 then S1-S3: write a CSV folder (one file per task) with NA tokens
    for missing text, quotes, commas and newlines inside fields, and codes
    that must stay text; read it back with type inference."""
    o = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("NA")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.concat("o_orderkey", F.lit("D")).alias("code"),
        F.concat(F.lit('say "'), "o_orderstatus", F.lit('", '), "o_orderpriority", F.lit("\nnext, line")).alias("note"))
    path = scratch_path(spark, "csv-roundtrip")
    files.write_table(o, path, fmt="csv")
    return files.read_csv(spark, path, multi_line=True)


# ---------------------------------------------------------------- filters / dedupe

@register("filter_rows", """SELECT * FROM lineitem
  WHERE l_quantity > 10 AND l_discount < 0.05 AND l_returnflag <> 'R'""")
def q_filter_rows(spark, d):
    return reshape.filter_rows(table(spark, d, "lineitem"),
                               "l_quantity > 10 AND l_discount < 0.05 AND l_returnflag <> 'R'")


@register("filter_in_list", """SELECT * FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000""")
def q_filter_in_list(spark, d):
    return reshape.filter_rows(table(spark, d, "orders"),
                               "o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000")


@register("dedupe_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def q_dedupe_rows(spark, d):
    return clean.dedupe(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


@register("dedupe_keep_first", """SELECT e.* FROM events e JOIN
  (SELECT user_id, event_type, min(event_id) AS m FROM events GROUP BY user_id, event_type) k
  ON e.event_id = k.m""")
def q_dedupe_keep_first(spark, d):
    return clean.dedupe(table(spark, d, "events"), ["user_id", "event_type"], order_by=["event_id"])


# ---------------------------------------------------------------- missing values

@register("missing_drop", f"""SELECT l_orderkey, l_linenumber, l_discount FROM {LINEITEM_MASKED_SQL} t
  WHERE l_discount IS NOT NULL""")
def q_missing_drop(spark, d):
    li = lineitem_masked(spark, d).select("l_orderkey", "l_linenumber", "l_discount")
    return clean.impute(li, [("l_discount", "drop")])


@register("missing_zero", f"""SELECT l_orderkey, l_linenumber, coalesce(l_discount, 0) AS l_discount,
  coalesce(l_returnflag, '0') AS l_returnflag FROM {LINEITEM_MASKED_SQL} t""")
def q_missing_zero(spark, d):
    li = lineitem_masked(spark, d).select("l_orderkey", "l_linenumber", "l_discount", "l_returnflag")
    return clean.impute(li, [("l_discount", "zero"), ("l_returnflag", "zero")])


@register("missing_mean", f"""SELECT l_orderkey, l_linenumber,
  round(coalesce(l_extendedprice, (SELECT avg(l_extendedprice) FROM {LINEITEM_MASKED_SQL} s)), {R}) AS l_extendedprice
  FROM {LINEITEM_MASKED_SQL} t""")
def q_missing_mean(spark, d):
    li = lineitem_masked(spark, d).select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = clean.impute(li, [("l_extendedprice", "mean")])
    return out.select("l_orderkey", "l_linenumber", rnd("l_extendedprice"))


@register("missing_median", f"""SELECT l_orderkey, l_linenumber,
  round(coalesce(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.5) FROM {LINEITEM_MASKED_SQL} s)), {R})
  AS l_extendedprice FROM {LINEITEM_MASKED_SQL} t""")
def q_missing_median(spark, d):
    li = lineitem_masked(spark, d).select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = clean.impute(li, [("l_extendedprice", "median")])
    return out.select("l_orderkey", "l_linenumber", rnd("l_extendedprice"))


@register("missing_mode", f"""SELECT o_orderkey, coalesce(o_orderpriority,
  (SELECT o_orderpriority FROM {ORDERS_MASKED_SQL} s WHERE o_orderpriority IS NOT NULL
   GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority ASC LIMIT 1)) AS o_orderpriority
  FROM {ORDERS_MASKED_SQL} t""")
def q_missing_mode(spark, d):
    o = orders_masked(spark, d).select("o_orderkey", "o_orderpriority")
    return clean.impute(o, [("o_orderpriority", "mode")])


@register("fill_forward", f"""SELECT event_id, last_value(value IGNORE NULLS) OVER
  (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {EVENTS_MASKED_SQL} t""")
def q_fill_forward(spark, d):
    ev = events_masked(spark, d).select("event_id", "value")
    return order.fill_ordered(ev, ["value"], ["event_id"], "forward")


@register("fill_backward", f"""SELECT event_id, first_value(value IGNORE NULLS) OVER
  (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {EVENTS_MASKED_SQL} t""")
def q_fill_backward(spark, d):
    ev = events_masked(spark, d).select("event_id", "value")
    return order.fill_ordered(ev, ["value"], ["event_id"], "backward")


@register("fill_forward_by_key", f"""SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER
  (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
  FROM {EVENTS_MASKED_SQL} t""")
def q_fill_forward_by_key(spark, d):
    ev = events_masked(spark, d).select("event_id", "user_id", "value")
    return order.fill_ordered(ev, ["value"], ["event_id"], "forward", partition_by=["user_id"])


@register("missing_plan", f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_discount, l_tax
  FROM {LINEITEM_MASKED_SQL} t WHERE l_discount IS NOT NULL)
SELECT l_orderkey, l_linenumber, l_discount,
  round(coalesce(l_tax, (SELECT avg(l_tax) FROM a)), {R}) AS l_tax FROM a""")
def q_missing_plan(spark, d):
    li = lineitem_masked(spark, d).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    out = clean.impute(li, [("l_discount", "drop"), ("l_tax", "mean")])
    return out.select("l_orderkey", "l_linenumber", "l_discount", rnd("l_tax"))


@register("missing_plan_ordered", f"""WITH a AS (SELECT event_id, user_id, event_type, value
  FROM {EVENTS_MASKED_SQL} t WHERE NOT (event_id % 11 = 0)),
b AS (SELECT event_id, user_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type,
  last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
  FROM a)
SELECT event_id, user_id, coalesce(event_type, (SELECT event_type FROM b WHERE event_type IS NOT NULL
  GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type, value FROM b""")
def q_missing_plan_ordered(spark, d):
    """N8 with an ordered step: drop rows missing user_id, forward-fill the
    value along event_id, then fill event_type with its mode."""
    ev = events_masked(spark, d).select(
        "event_id", F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"), "value")
    return clean.impute(ev, [("user_id", "drop"), ("value", "forward"), ("event_type", "mode")],
                        order_by=["event_id"])


# ---------------------------------------------------------------- casts

@register("cast_int", """SELECT p_partkey, CAST(p_size AS BIGINT) AS size_int,
  CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(p_retailprice AS BIGINT) END AS price_int,
  CAST(NULL AS BIGINT) AS name_int FROM part""")
def q_cast_int(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey",
                    casts.to_int(F.col("p_size").cast("string"), None).alias("size_int"),
                    casts.to_int("p_retailprice", p.schema["p_retailprice"].dataType, "null").alias("price_int"),
                    casts.to_int("p_name", p.schema["p_name"].dataType, "null").alias("name_int"))


@register("cast_float", """SELECT p_partkey, CAST(p_size AS DOUBLE) AS size_float,
  TRY_CAST(p_brand AS DOUBLE) AS brand_float FROM part""")
def q_cast_float(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", casts.to_float(F.col("p_size").cast("string")).alias("size_float"),
                    casts.to_float("p_brand").alias("brand_float"))


@register("cast_codes", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN CAST(p_size AS DOUBLE) END AS code_float,
  CASE WHEN p_partkey % 4 = 3 THEN CAST(p_size AS BIGINT) END AS code_int,
  CASE WHEN p_partkey % 4 = 3 THEN CAST(p_size AS DOUBLE) ELSE -1.0 END AS code_num FROM part""")
def q_cast_codes(spark, d):
    """Text that a cast of the engine would read as a number (10D, 1f, 0x1p3) is a code, not a number."""
    p = table(spark, d, "part")
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    code = F.when(kind == 0, F.concat(size, F.lit("D"))).when(kind == 1, F.concat(size, F.lit("f"))).when(kind == 2, F.concat(F.lit("0x"), size, F.lit("p3"))).otherwise(size)
    return p.select("p_partkey", casts.to_float(code).alias("code_float"), casts.to_int(code, None, "null").alias("code_int"),
                    casts.coerce_default(code, -1.0).alias("code_num"))


@register("cast_decimal", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) END AS whole,
  CAST(p_size AS BIGINT) AS cut FROM part""")
def q_cast_decimal(spark, d):
    """A decimal with a fraction is no integer."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(0.7)).cast("decimal(12,2)").alias("v"))
    dt = p.schema["v"].dataType
    return p.select("p_partkey", casts.to_int("v", dt, "null").alias("whole"), casts.to_int("v", dt, "truncate").alias("cut"))


@register("fill_many_nan", """SELECT event_id, last_value(q IGNORE NULLS) OVER w AS "q.1", last_value(t IGNORE NULLS) OVER w AS "t x"
  FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS q, CASE WHEN event_id % 3 < 2 THEN NULL ELSE value END AS t FROM events) s
  WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_fill_many_nan(spark, d):
    """N6 on two columns at once, NaN standing for missing, names with a dot and a blank."""
    nan, value = F.lit(float("nan")), F.col("value").cast("double")
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, nan).otherwise(value).alias("q.1"),
                                            F.when(F.col("event_id") % 3 < 2, nan).otherwise(value).alias("t x"))
    return order.fill_ordered(rows, ["q.1", "t x"], ["event_id"])


@register("odd_names", f"""SELECT l_returnflag AS "p/q", round(avg(coalesce(l_quantity, m)), {R}) AS "a.1_mean" FROM
  (SELECT l_returnflag, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity FROM lineitem),
  (SELECT avg(CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END) AS m FROM lineitem) GROUP BY l_returnflag""")
def q_odd_names(spark, d):
    """N3 and A1 over column names with dots, blanks and slashes."""
    li = table(spark, d, "lineitem").select(mask("l_quantity", F.col("l_linenumber") % 5 == 0), "l_returnflag", "l_linenumber").toDF("a.1", "p/q", "x y")
    out = reshape.group_aggregate(reshape.sort_rows(clean.fill_mean(clean.drop_missing(li, ["x y"]), ["a.1"]), "x y"), "p/q", "a.1", "mean")
    return out.select("p/q", F.round("`a.1_mean`", R).alias("a.1_mean"))


@register("odd_names_more", f"""WITH t AS (SELECT l_returnflag, l_quantity, l_orderkey, l_linenumber, l_linestatus FROM lineitem),
m AS (SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), {R}) AS median, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), {R}) AS open_sum FROM t GROUP BY 1),
f AS (SELECT l_returnflag, count(*) FILTER (WHERE h % 100 < 80) AS train_rows, count(*) FILTER (WHERE h % 5 = 0) AS fold_0 FROM
  (SELECT l_returnflag, CAST('0x' || substr(md5('42' || '|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM t) GROUP BY 1),
s AS (SELECT l_returnflag, count(*) AS sampled FROM (SELECT l_returnflag FROM t ORDER BY md5('42' || '|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)) LIMIT 500) GROUP BY 1),
a AS (SELECT l_returnflag, CAST(1 AS DOUBLE) AS accuracy FROM (SELECT DISTINCT l_returnflag FROM t))
SELECT l_returnflag AS "p/q", median AS "a.1_median", open_sum, train_rows, fold_0, coalesce(sampled, 0) AS sampled, accuracy FROM m JOIN f USING (l_returnflag) LEFT JOIN s USING (l_returnflag) JOIN a USING (l_returnflag)""")
def q_odd_names_more(spark, d):
    """Median, pivot, split, folds, sample and metrics over column names with dots, blanks and slashes."""
    li = table(spark, d, "lineitem").select("l_quantity", "l_returnflag", "l_orderkey", "l_linenumber", "l_linestatus").toDF("a.1", "p/q", "key.1", "key 2", "s.t")
    keys = ["key.1", "key 2"]
    median = reshape.group_aggregate(li, "p/q", "a.1", "median").withColumn("a.1_median", F.round("`a.1_median`", R))
    pivot = reshape.pivot_table(li, "p/q", "s.t", "a.1", "sum", ["F", "O"]).select("p/q", F.round("O", R).alias("open_sum"))
    train, _ = sampling.hash_split(li, keys, 80)
    train = train.groupBy("p/q").agg(F.count("*").alias("train_rows"))
    folds = sampling.assign_folds(li, keys, 5).groupBy("p/q").agg(F.count_if(F.col("fold") == 0).alias("fold_0"))
    sampled = sampling.sample_n(li, 500, keys).groupBy("p/q").agg(F.count("*").alias("sampled"))
    accuracy = evaluate.accuracy_score(li.withColumn("a.2", quoted("a.1")), "a.1", "a.2")
    out = median.join(pivot, "p/q").join(train, "p/q").join(folds, "p/q").join(sampled, "p/q", "left").crossJoin(F.broadcast(accuracy))
    return out.withColumn("sampled", F.coalesce("sampled", F.lit(0)))


@register("group_median_many", f"""SELECT k, round(quantile_cont(l_extendedprice, 0.5), {R}) AS l_extendedprice_median FROM
  (SELECT CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE l_orderkey * 10 + l_linenumber END AS k, l_extendedprice FROM lineitem) GROUP BY k""")
def q_group_median_many(spark, d):
    """A1 median of hundreds of thousands of groups (at sf0.1), one of which holds a large part of the rows."""
    key = F.when(F.col("l_linenumber") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber"))
    out = reshape.group_aggregate(table(spark, d, "lineitem").select(key.alias("k"), "l_extendedprice"), "k", "l_extendedprice", "median")
    return out.select("k", rnd("l_extendedprice_median"))


@register("cast_string", """SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_str,
  CAST(p_retailprice AS VARCHAR) AS price_str FROM part""")
def q_cast_string(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", casts.to_string("p_size").alias("size_str"),
                    casts.to_string("p_retailprice").alias("price_str"))


@register("cast_date", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_day,
  CAST(o_orderdate AS DATE) AS parsed_day, CAST(NULL AS DATE) AS bad_day FROM orders""")
def q_cast_date(spark, d):
    o = table(spark, d, "orders")
    text = F.date_format("o_orderdate", "yyyy/MM/dd")
    return o.select("o_orderkey", casts.to_date("o_orderdate", o.schema["o_orderdate"].dataType).alias("order_day"),
                    casts.to_date(text).alias("parsed_day"),
                    casts.to_date(F.concat(F.lit("2024-13-"), F.col("o_orderkey").cast("string"))).alias("bad_day"))


@register("cast_date_by_column", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day_first,
  CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) WHEN day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END AS mixed,
  CAST(o_orderdate AS DATE) AS month_first FROM orders""")
def q_cast_date_by_column(spark, d):
    """C4: the column decides between day first and month first; in a mixed one the values of the other order are swapped or NULL."""
    o = table(spark, d, "orders")
    by_day, by_month = F.date_format("o_orderdate", "dd/MM/yyyy"), F.date_format("o_orderdate", "MM/dd/yyyy")
    texts = o.select("o_orderkey", by_day.alias("day_first"), F.when(F.col("o_orderkey") % 10 == 0, by_month).otherwise(by_day).alias("mixed"), by_month.alias("month_first"))
    return apply_casts(texts, [(c, "datetime") for c in ("day_first", "mixed", "month_first")])


@register("plan_passthrough", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_plan_passthrough(spark, d):
    """P4, A1h, C8: unknown options and blank or bad steps leave the table as it is (``on_error='skip'``)."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return apply_plan(n, PrepPlan(index="whatever", filter="   ", group=("n_name", "n_regionkey", "no such function"), pivot=("n_name", "missing", "n_regionkey", "mean"), on_error="skip"))


@register("cast_category", """SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, p_brand FROM part""")
def q_cast_category(spark, d):
    """A category column stays text."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    return apply_casts(p, [("p_size", "category"), ("p_brand", "category")])


@register("label_column", """SELECT o_orderkey AS label, o_custkey, o_totalprice, 'o_custkey,o_totalprice' AS features FROM orders""")
def q_label_column(spark, d):
    """The first column as row label, out of the features, then a plain column again."""
    marked = load.mark_label(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")
    feats = ",".join(load.feature_names(marked))
    return load.label_to_column(marked, "label").withColumn("features", F.lit(feats))


@register("load_row_label", """SELECT o_orderkey, o_custkey, o_totalprice, 'o_orderkey' AS label FROM orders""")
def q_load_row_label(spark, d):
    """S5 at load: the first column of a written table, sequential in file order, becomes the row label and stays it through filters and joins."""
    path = scratch_path(spark, "labelled")
    order.sort_for_files(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"]).write.option("header", True).csv(path)
    loaded = load.load_table(spark, path)
    kept = loaded.where("o_custkey >= 0").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left")
    kept = kept.select("o_orderkey", "o_custkey", "o_totalprice")
    return kept.withColumn("label", F.lit(load.label_of(kept)))


@register("load_blank_lead", """SELECT row_number() OVER (ORDER BY o_orderkey) AS "Index", o_orderkey, o_custkey FROM orders""")
def q_load_blank_lead(spark, d):
    """S2 at load: a blank first column goes, and the rows are numbered in file order."""
    path = scratch_path(spark, "blank-lead")
    rows = table(spark, d, "orders").select(F.lit(None).cast("string").alias("Unnamed: 0"), "o_orderkey", "o_custkey")
    order.sort_for_files(rows, ["o_orderkey"]).write.option("header", True).csv(path)
    return load.load_table(spark, path)


@register("cast_epoch_date", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS from_ns,
  CAST(make_timestamp(CAST(floor(o_orderkey / 1000) AS BIGINT)) AS DATE) AS key_as_ns FROM orders""")
def q_cast_epoch_date(spark, d):
    o = table(spark, d, "orders")
    ns = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("ns")
    o2 = o.select("o_orderkey", ns)
    return o2.select("o_orderkey", casts.to_date("ns", o2.schema["ns"].dataType).alias("from_ns"),
                     casts.to_date("o_orderkey", o2.schema["o_orderkey"].dataType).alias("key_as_ns"))


@register("coerce_default", """SELECT p_partkey, coalesce(TRY_CAST(p_brand AS DOUBLE), 0.0) AS brand_num,
  coalesce(TRY_CAST(CAST(p_size AS VARCHAR) AS DOUBLE), -1.0) AS size_num FROM part""")
def q_coerce_default(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", casts.coerce_default("p_brand", 0.0).alias("brand_num"),
                    casts.coerce_default(F.col("p_size").cast("string"), -1.0).alias("size_num"))


# ---------------------------------------------------------------- group-by

_GROUP_SQL = {
    "mean": "avg(l_extendedprice)",
    "sum": "coalesce(sum(l_extendedprice), 0)",
    "count": "CAST(count(l_extendedprice) AS BIGINT)",
    "min": "min(l_extendedprice)",
    "max": "max(l_extendedprice)",
    "std": "stddev_samp(l_extendedprice)",
    "median": "quantile_cont(l_extendedprice, 0.5)",
}


def _group_query(fn):
    def q(spark, d):
        out = reshape.group_aggregate(lineitem_masked(spark, d), "l_returnflag", "l_extendedprice", fn)
        col = f"l_extendedprice_{fn}"
        return out.select("l_returnflag", rnd(col) if fn != "count" else F.col(col))
    return q


for _fn, _agg in _GROUP_SQL.items():
    _expr = _agg if _fn == "count" else f"round({_agg}, {R})"
    register(f"group_{_fn}", f"""SELECT l_returnflag, {_expr} AS l_extendedprice_{_fn}
  FROM {LINEITEM_MASKED_SQL} t WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")(_group_query(_fn))


# ---------------------------------------------------------------- pivot

def _pivot_sql(fn):
    cells = []
    for s in ("F", "O"):
        f = f"WHERE l_linestatus = '{s}'"
        if fn == "mean":
            e = f"round(avg(l_quantity) FILTER ({f}), {R})"
        elif fn in ("min", "max"):
            e = f"{fn}(l_quantity) FILTER ({f})"
        elif fn == "sum":
            e = f"CASE WHEN count(*) FILTER ({f}) > 0 THEN round(coalesce(sum(l_quantity) FILTER ({f}), 0), {R}) END"
        else:
            e = f"CASE WHEN count(*) FILTER ({f}) > 0 THEN CAST(count(l_quantity) FILTER ({f}) AS BIGINT) END"
        cells.append(f'{e} AS "{s}"')
    where = "l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL"
    if fn in ("mean", "min", "max"):
        where += " AND l_quantity IS NOT NULL"
    return f"""SELECT l_returnflag, {", ".join(cells)} FROM {LINEITEM_MASKED_SQL} t
  WHERE {where} GROUP BY l_returnflag"""


def _pivot_query(fn):
    def q(spark, d):
        out = reshape.pivot_table(lineitem_masked(spark, d), "l_returnflag", "l_linestatus", "l_quantity", fn)
        return out.select("l_returnflag", *[rnd(c) if fn in ("mean", "sum") else F.col(c)
                                            for c in out.columns[1:]])
    return q


for _fn in ("mean", "sum", "count", "min", "max"):
    register(f"pivot_{_fn}", _pivot_sql(_fn))(_pivot_query(_fn))


@register("pivot_long", f"""SELECT l_returnflag, l_partkey, round(coalesce(sum(l_quantity), 0), {R}) AS value
  FROM {LINEITEM_MASKED_SQL} t WHERE l_returnflag IS NOT NULL AND l_partkey IS NOT NULL
  GROUP BY l_returnflag, l_partkey""")
def q_pivot_long(spark, d):
    """A2 long form over a column with more values than a wide pivot allows
    (20,000 part keys at sf0.1): one row per (index, column value) cell."""
    out = reshape.pivot_cells(lineitem_masked(spark, d), "l_returnflag", "l_partkey", "l_quantity", "sum")
    return out.select("l_returnflag", "l_partkey", rnd("__cell", "value"))


# ---------------------------------------------------------------- profile

_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LI_NUM = _LI_COLS[:8]


@register("missing_report", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS missing,
  round((count(*) - count({c})) * 100.0 / count(*), {R}) AS missing_pct FROM {LINEITEM_MASKED_SQL} t"""
    for c in _LI_COLS))
def q_missing_report(spark, d):
    out = profile.missing_report(lineitem_masked(spark, d))
    return out.select("column", "missing", rnd("missing_pct"))


def _describe_sql(cols, src):
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS "count", round(avg({c}), {R}) AS mean,
  round(stddev_samp({c}), {R}) AS std, round(CAST(min({c}) AS DOUBLE), {R}) AS "min",
  round(quantile_cont({c}, 0.25), {R}) AS q25, round(quantile_cont({c}, 0.5), {R}) AS q50,
  round(quantile_cont({c}, 0.75), {R}) AS q75, round(CAST(max({c}) AS DOUBLE), {R}) AS "max" FROM {src} t"""
        for c in cols)


@register("describe_numeric", _describe_sql(_LI_NUM, LINEITEM_MASKED_SQL))
def q_describe_numeric(spark, d):
    out = profile.describe_numeric(lineitem_masked(spark, d))
    return out.select("column", "count", *[rnd(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


_O_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
_O_OTHER = ["o_orderstatus", "o_orderdate", "o_orderpriority"]


@register("column_stats_numeric", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", round(avg({c}), {R}) AS mean, round(stddev_samp({c}), {R}) AS std,
  round(CAST(min({c}) AS DOUBLE), {R}) AS "min", round(CAST(max({c}) AS DOUBLE), {R}) AS "max",
  CAST(count(*) - count({c}) AS BIGINT) AS missing FROM {ORDERS_MASKED_SQL} t""" for c in _O_NUM))
def q_column_stats_numeric(spark, d):
    num, _ = profile.column_stats(orders_masked(spark, d))
    return num.select("column", *[rnd(c) for c in ("mean", "std", "min", "max")], "missing")


@register("column_stats_categorical", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count,
  CAST(count(*) - count({c}) AS BIGINT) AS missing FROM {ORDERS_MASKED_SQL} t""" for c in _O_OTHER))
def q_column_stats_categorical(spark, d):
    return profile.column_stats(orders_masked(spark, d))[1]


@register("distinct_counts", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count FROM lineitem"""
    for c in _LI_COLS))
def q_distinct_counts(spark, d):
    return profile.distinct_counts(table(spark, d, "lineitem"))


def _profile_sql():
    types = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
             "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
    kinds = {"bigint": "numeric", "double": "numeric", "string": "categorical", "timestamp_ntz": "other"}
    parts = []
    for c, t in types.items():
        num = kinds[t] == "numeric"
        stats = (f"""CAST(count({c}) AS BIGINT) AS "count", round(avg({c}), {R}) AS mean, round(stddev_samp({c}), {R}) AS std,
  round(CAST(min({c}) AS DOUBLE), {R}) AS "min", round(quantile_cont({c}, 0.25), {R}) AS q25,
  round(quantile_cont({c}, 0.5), {R}) AS q50, round(quantile_cont({c}, 0.75), {R}) AS q75,
  round(CAST(max({c}) AS DOUBLE), {R}) AS "max\"""" if num else
                 """CAST(NULL AS BIGINT) AS "count", CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std,
  CAST(NULL AS DOUBLE) AS "min", CAST(NULL AS DOUBLE) AS q25, CAST(NULL AS DOUBLE) AS q50,
  CAST(NULL AS DOUBLE) AS q75, CAST(NULL AS DOUBLE) AS "max\"""")
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS dtype, '{kinds[t]}' AS kind,
  CAST(count(*) AS BIGINT) AS "rows", CAST(count(*) - count({c}) AS BIGINT) AS missing,
  round((count(*) - count({c})) * 100.0 / count(*), {R}) AS missing_pct, {stats} FROM {ORDERS_MASKED_SQL} t""")
    return "\nUNION ALL\n".join(parts)


@register("profile_table", _profile_sql())
def q_profile_table(spark, d):
    out = profile.profile_table(orders_masked(spark, d))
    return out.select("column", "dtype", "kind", "rows", "missing", rnd("missing_pct"), "count",
                      *[rnd(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


# ---------------------------------------------------------------- sort / head

@register("sort_limit", """SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20""")
def q_sort_limit(spark, d):
    return reshape.sort_rows(table(spark, d, "orders"), "o_totalprice", ascending=False, first=20)


@register("preview_head", """SELECT * FROM orders ORDER BY o_orderkey LIMIT 5""")
def q_preview_head(spark, d):
    return reshape.head_rows(table(spark, d, "orders"), 5, ["o_orderkey"])


# ---------------------------------------------------------------- row sets

@register("union_rows", """SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS o_orderpriority
  FROM orders WHERE o_orderstatus = 'F'
  UNION ALL
  SELECT o_orderkey, CAST(NULL AS DOUBLE), o_orderpriority FROM orders WHERE o_orderstatus = 'O'""")
def q_union_rows(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    b = o.where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority")
    return sampling.union_rows(a, b)


@register("sample_n", f"""SELECT * FROM customer
  ORDER BY md5('42' || '|' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 100""")
def q_sample_n(spark, d):
    return sampling.sample_n(table(spark, d, "customer"), 100, ["c_custkey"], seed=42)


@register("split_train", f"SELECT * FROM orders WHERE {_hash_sql('o_orderkey')} % 100 < 80")
def q_split_train(spark, d):
    return sampling.hash_split(table(spark, d, "orders"), ["o_orderkey"], 80, 42)[0]


@register("split_holdout", f"SELECT * FROM orders WHERE {_hash_sql('o_orderkey')} % 100 >= 80")
def q_split_holdout(spark, d):
    return sampling.hash_split(table(spark, d, "orders"), ["o_orderkey"], 80, 42)[1]


@register("split_stratified", f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus
          ORDER BY md5('42' || '|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r,
        count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) t
  WHERE r <= n - ceil(0.2 * n)""")
def q_split_stratified(spark, d):
    return sampling.stratified_split(table(spark, d, "orders"), "o_orderstatus", ["o_orderkey"], 0.8, 42)[0]


@register("kfold_assign", f"SELECT o_orderkey, CAST({_hash_sql('o_orderkey')} % 5 AS INTEGER) AS fold FROM orders")
def q_kfold_assign(spark, d):
    return sampling.assign_folds(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 5, 42)


@register("align_columns", "SELECT p_partkey, CAST(0.0 AS DOUBLE) AS p_extra, p_size FROM part")
def q_align_columns(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_name")
    return sampling.align_columns(p, ["p_partkey", "p_extra", "p_size"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import ml_registry  # noqa: F401  (registers the model queries)
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import ml_registry  # noqa: F401
    return dict(ORACLE)

