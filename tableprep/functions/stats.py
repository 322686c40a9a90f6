"""Aggregates whose built-in Spark form does not scale.

* ``percentile`` / ``median`` keep every distinct value of a group in one
  aggregation buffer, so a global median of a 100 TB column (or the median
  of a group holding a third of all rows) lands in one task.
  ``exact_quantiles`` gives the same answer (linear interpolation between
  closest ranks, the pandas / ``quantile_cont`` rule): groups of bounded size
  are sorted whole, big ones take three bounded passes: a
  ``percentile_approx`` bracket, exact rank counts, and an exact sort of the
  few values strictly inside the bracket.
* ``mode`` builds a value -> count map per group; ``mode_of`` counts with an
  ordinary group-by (partial aggregation, one row per value after the
  shuffle) and picks the winner with a ``min(struct(...))`` aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import quoted


# Largest group table that is broadcast to the rows: rows and bytes.
BROADCAST_GROUP_LIMIT = 200_000
BROADCAST_GROUP_BYTES = 64 << 20

# Rows that a task sorts of groups that are sorted whole.
SORTED_ROWS = 250_000

_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _join_same(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys; a NULL key is a group like any other."""
    other = other.withColumnsRenamed({k: f"__of_{i}" for i, k in enumerate(keys)})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__of_{i}")) for i, k in enumerate(keys)))
    return rows.join(other, same, how).drop(*(f"__of_{i}" for i in range(len(keys))))


class GroupJoin:
    """How a per-group table meets the rows of its groups.

    Up to the limits (both measured) the whole table is broadcast.  Beyond them the groups
    are told apart by size: those of over ``hot`` rows, so few that their part of the table
    is within the limits, are broadcast to their rows, which stay where they are and are
    summed per task before any shuffle; the rest of the rows, in groups of at most ``hot``
    rows, meet the rest of the table in a shuffle join.  So a group with a third of all
    rows is never gathered, however many groups there are."""

    def __init__(self, sizes: DataFrame, keys: list[str], row_bytes: int):
        # sizes: the keys and __n, the rows of each group
        self.keys, self.hot, self.hot_keys = keys, None, None
        n, size = _group_table_size(sizes, keys, row_bytes)
        if n <= BROADCAST_GROUP_LIMIT and size <= BROADCAST_GROUP_BYTES:
            return
        self.hot = max(1, int(sizes.agg(F.sum("__n")).first()[0] or 0) // max(1, BROADCAST_GROUP_LIMIT))
        while True:  # groups of over 1 / limit of the rows are fewer than the limit; their keys may still be long
            self.hot_keys = sizes.where(F.col("__n") > self.hot).select(*keys)
            if _group_table_size(self.hot_keys, keys, row_bytes)[1] <= BROADCAST_GROUP_BYTES:
                return
            self.hot *= 4

    def join(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        if self.hot is None:
            return _join_same(rows, F.broadcast(groups), self.keys)
        marked = _join_same(rows, F.broadcast(self.hot_keys.withColumn("__hot", F.lit(True))), self.keys, "left")
        hot = _join_same(marked.where("__hot").drop("__hot"), F.broadcast(_join_same(groups, F.broadcast(self.hot_keys), self.keys)), self.keys)
        return hot.unionByName(_join_same(marked.where("__hot IS NULL").drop("__hot"), groups, self.keys))

    def others(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """The rows of all groups but these."""
        groups = groups.select(*self.keys)
        if self.hot is None:
            return _join_same(rows, F.broadcast(groups), self.keys, "left_anti")
        return _join_same(_join_same(rows, F.broadcast(self.hot_keys), self.keys, "left_anti"), groups, self.keys, "left_anti")


def _group_table_size(stats: DataFrame, keys: Sequence[str], row_bytes: int) -> tuple[int, int]:
    """(groups, bytes) of a per-group table: fixed-width keys count 8 bytes,
    variable-width keys their measured text length."""
    types = {f.name: f.dataType for f in stats.schema.fields}
    var = [c for c in keys if not isinstance(types[c], _FIXED)]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(F.octet_length(quoted(c).cast("string"))).alias(f"b{i}")
                                             for i, c in enumerate(var)]
    r = stats.agg(*aggs).collect()[0]
    n = int(r["n"])
    var_bytes = sum(int(r[f"b{i}"] or 0) for i in range(len(var)))
    return n, n * (row_bytes + 8 * (len(keys) - len(var))) + var_bytes


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    group_cols: Sequence[str] = (), accuracy: int = 10_000,
                    names: Sequence[str] | None = None, max_candidates: int = 100_000,
                    grid: int = 1000, max_rounds: int = 8, extra_aggs=None) -> DataFrame:
    """Exact quantiles of ``value_col`` per group, linear interpolation
    between closest ranks (pandas ``quantile`` / SQL ``quantile_cont``).

    NULL and NaN values are ignored; a group with no value gives NULL.
    Returns one row per group: ``group_cols`` then one double column per
    probability (``names`` or ``q0, q1, ...``).

    Groups are counted, and those of at most ``max_candidates`` rows are
    sorted whole, in one shuffle by the group (``_sorted_whole``).  The few
    others meet a small state table with one row per (group, target):
    a ``percentile_approx`` grid (``grid`` steps, rank error n/accuracy)
    brackets each target rank with a two-step margin, exact counts at the
    bracket ends verify it, and a bracket still holding more than
    ``max_candidates`` values is narrowed again on its own values.  The last
    pass sorts only the values strictly inside each bracket.  When no group can
    hold more than ``max_candidates`` values inside a first bracket, the
    counting pass also collects those values (sorted, per target), so two
    scans answer everything.

    ``extra_aggs`` maps output names to functions of the value column (e.g.
    ``{"mean": F.avg}``), returned after the quantile columns.
    """
    probs = [float(p) for p in probs]
    if any(p < 0 or p > 1 for p in probs):
        raise ValueError("probabilities must lie in [0, 1]")
    names = list(names) if names is not None else [f"q{i}" for i in range(len(probs))]
    user_g = list(group_cols)
    # groups travel under names of their own, whatever the table's are
    g = [f"__k{i}" for i in range(len(user_g))] or ["__one"]
    k = len(probs)
    gp = [j / grid for j in range(grid + 1)]
    inf = float("inf")
    extra = dict(extra_aggs or {})

    v = quoted(value_col).cast("double")
    group_exprs = [quoted(c).alias(k) for c, k in zip(user_g, g)] or [F.lit(0).alias("__one")]
    # NaN is folded into NULL so that both are skipped by every pass.
    base_all = df.select(*group_exprs, F.when(F.isnan(v), F.lit(None)).otherwise(v).alias("__v"))

    base = base_all.where(F.col("__v").isNotNull())

    # Groups too big to sort whole, missing values included: at most one in max_candidates rows.
    sizes = base_all.groupBy(*g).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max_candidates).persist()
    if sizes.isEmpty():
        return _sorted_whole(base_all, g, user_g, probs, names, extra)
    # the bracket state per group: k targets of (index, lo, hi) plus overhead
    meeting = GroupJoin(sizes, g, 32 * k + 64)
    rest = _sorted_whole(meeting.others(base_all, sizes), g, user_g, probs, names, extra) if user_g else None

    # Round 0: a quantile grid over every whole big group.
    stats = meeting.join(base_all, sizes.select(*g)).groupBy(*g).agg(
        F.count("__v").alias("__n"), F.percentile_approx("__v", gp, accuracy).alias("__grid"),
        *[fn(F.col("__v")).alias(name) for name, fn in extra.items()])
    targets = []
    for i, p in enumerate(probs):
        pos = (F.col("__n") - 1) * F.lit(p)
        targets.append(F.struct(F.lit(i).alias("i"), F.floor(pos).cast("bigint").alias("j0"),
                                F.least(F.floor(pos).cast("bigint") + 1, F.col("__n") - 1).alias("j1"),
                                (pos - F.floor(pos)).alias("frac")))
    stats = stats.persist()
    state = (stats.where(F.col("__n") > 0)
             .select(*g, "__n", "__grid", F.explode(F.array(*targets)).alias("t"))
             .select(*g, "__n", "__grid", "t.*"))
    state = state.select(*g, "__n", "i", "j0", "j1", "frac",
                         *_bracket(F.lit(0), F.col("__n"), F.lit(-inf), F.lit(inf), F.lit(False), grid)).persist()
    top = state.agg(F.max("__n")).first()[0] or 0

    def whole(res: DataFrame) -> DataFrame:
        out = _finish(res, stats, g, user_g, names, k, list(extra))
        return out if rest is None else out.unionByName(rest)

    def with_state(rows: DataFrame, st: DataFrame, fields) -> DataFrame:
        arr = st.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("i", *fields))).alias("__br"))
        return meeting.join(rows, arr)

    if top <= max_candidates * grid // 8:
        # A first bracket spans about five grid steps (5n/grid values) plus the
        # sketch error, so it holds fewer than max_candidates values: one pass
        # counts the bracket ends and collects the inside values, sorted.
        joined = with_state(base, state, ["lo", "hi"])
        aggs = []
        for i in range(k):
            b = F.col("__br")[i]
            inside = (F.col("__v") > b["lo"]) & (F.col("__v") < b["hi"])
            aggs += [F.count_if(F.col("__v") < b["lo"]).alias(f"a{i}"),
                     F.count_if(F.col("__v") <= b["lo"]).alias(f"b{i}"),
                     F.count_if(F.col("__v") < b["hi"]).alias(f"c{i}"),
                     F.count_if(F.col("__v") <= b["hi"]).alias(f"d{i}"),
                     F.sort_array(F.collect_list(F.when(inside, F.col("__v")))).alias(f"e{i}")]
        counts = joined.groupBy(*g).agg(*aggs).select(*g, F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.col(f"a{i}").alias("lt_lo"), F.col(f"b{i}").alias("le_lo"),
                     F.col(f"c{i}").alias("lt_hi"), F.col(f"d{i}").alias("le_hi"), F.col(f"e{i}").alias("arr"))
            for i in range(k)])).alias("c")).select(*g, "c.*")
        res = _join_same(state.select(*g, "i", "j0", "j1", "frac", "lo", "hi"), counts, [*g, "i"])
        for m, j in (("m0", "j0"), ("m1", "j1")):
            idx = (F.col(j) - F.col("le_lo") + 1).cast("int")
            res = res.withColumn(m, F.when(idx >= 1, F.try_element_at("arr", idx)))
        return whole(res)

    for _ in range(max_rounds):
        # Exact counts at the bracket ends (one scan, one row per group).
        joined = with_state(base, state, ["lo", "hi"])
        aggs = []
        for i in range(k):
            b = F.col("__br")[i]
            aggs += [F.count_if(F.col("__v") < b["lo"]).alias(f"a{i}"),
                     F.count_if(F.col("__v") <= b["lo"]).alias(f"b{i}"),
                     F.count_if(F.col("__v") < b["hi"]).alias(f"c{i}"),
                     F.count_if(F.col("__v") <= b["hi"]).alias(f"d{i}")]
        counts = joined.groupBy(*g).agg(*aggs)
        counts = counts.select(*g, F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.col(f"a{i}").alias("lt_lo"), F.col(f"b{i}").alias("le_lo"),
                     F.col(f"c{i}").alias("lt_hi"), F.col(f"d{i}").alias("le_hi")) for i in range(k)])
        ).alias("c")).select(*g, "c.*")
        nxt = _join_same(state.select(*g, "__n", "i", "j0", "j1", "frac", "lo", "hi"), counts, [*g, "i"])
        mid = F.col("lt_hi") - F.col("le_lo")
        in_mid = lambda j: (j >= F.col("le_lo")) & (j < F.col("lt_hi"))
        nxt = nxt.withColumn("need", in_mid(F.col("j0")) | in_mid(F.col("j1"))).withColumn("mid", mid)
        nxt = nxt.persist()
        nxt.count()
        state.unpersist()
        state = nxt
        big = state.where(F.col("need") & (F.col("mid") > max_candidates))
        if big.isEmpty():
            break
        # Narrow the big brackets with a grid over their own inside values.
        inside = with_state(base, big, ["lo", "hi"]).select(
            *g, "__v", F.explode(F.filter("__br", lambda b: (F.col("__v") > b["lo"]) & (F.col("__v") < b["hi"])))
            .alias("b")).select(*g, F.col("b.i").alias("i"), "__v")
        grids = inside.groupBy(*g, "i").agg(F.percentile_approx("__v", gp, accuracy).alias("__grid"))
        upd = _join_same(state, grids, [*g, "i"], "left")
        refine = F.col("__grid").isNotNull()
        new_lo, new_hi = _bracket(F.col("le_lo"), F.col("mid"), F.col("lo"), F.col("hi"), F.lit(False), grid)
        upd = upd.select(*g, "__n", "i", "j0", "j1", "frac",
                         F.when(refine, new_lo).otherwise(F.col("lo")).alias("lo"),
                         F.when(refine, new_hi).otherwise(F.col("hi")).alias("hi")).persist()
        upd.count()
        state.unpersist()
        state = upd
    else:
        raise RuntimeError("exact_quantiles: brackets did not narrow; raise accuracy or max_candidates")

    # Last pass: exact order of the values strictly inside each needed bracket.
    needed = state.where("need")
    cand = (with_state(base, needed, ["lo", "hi"])
            .select(*g, "__v", F.explode(F.filter("__br", lambda b: (F.col("__v") > b["lo"])
                                                  & (F.col("__v") < b["hi"]))).alias("b"))
            .select(*g, F.col("b.i").alias("i"), "__v"))
    cand = cand.withColumn("__r", F.row_number().over(Window.partitionBy(*g, "i").orderBy("__v")) - 1)
    pick = needed.select(*g, "i", "j0", "j1", "le_lo")
    r = F.col("__r") + F.col("le_lo")
    picked = (_join_same(cand, pick, [*g, "i"]).where((r == F.col("j0")) | (r == F.col("j1")))
              .groupBy(*g, "i").agg(F.max(F.when(r == F.col("j0"), F.col("__v"))).alias("m0"),
                                    F.max(F.when(r == F.col("j1"), F.col("__v"))).alias("m1")))
    res = _join_same(state, picked, [*g, "i"], "left")
    return whole(res)


def _sorted_whole(rows: DataFrame, g, user_g, probs: Sequence[float], names, extra: Mapping) -> DataFrame:
    """Quantiles of groups that are sorted whole, one row per group: one shuffle
    by the group, in which every value learns its rank and its group's size."""
    of = Window.partitionBy(*g).orderBy(F.col("__v").asc_nulls_last())
    n = F.count("__v").over(of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    if user_g:  # a number of partitions that is asked for is not merged by their packed size
        rows = rows.repartition(max(1, -(-rows.count() // SORTED_ROWS)), *g)
    ranked = rows.withColumns({"__r": F.row_number().over(of).cast("bigint") - 1, "__n": n})
    picks, quantiles = [], []
    for i, p in enumerate(probs):
        pos = (F.col("__n") - 1) * F.lit(p)
        low = F.floor(pos).cast("bigint")
        picks += [F.max(F.when(F.col("__r") == low, F.col("__v"))).alias(f"__a{i}"),
                  F.max(F.when(F.col("__r") == F.least(low + 1, F.col("__n") - 1), F.col("__v"))).alias(f"__b{i}")]
        quantiles.append((F.col(f"__a{i}") + (pos - F.floor(pos)) * (F.col(f"__b{i}") - F.col(f"__a{i}"))).alias(names[i]))
    # grouped by constants, a table without rows would have no row
    by = ranked.groupBy(*g) if user_g else ranked
    out = by.agg(F.max("__n").alias("__n"), *picks, *[fn(F.col("__v")).alias(name) for name, fn in extra.items()])
    return out.select(*[F.col(k).alias(c) for k, c in zip(g, user_g)], *quantiles, *map(quoted, extra))


def _finish(res: DataFrame, stats: DataFrame, g, user_g, names, k: int, extra_names) -> DataFrame:
    """Interpolate every target from its bracket counts and mid values, one
    row per group (groups with no value keep NULL quantiles)."""
    def value_at(j, m):
        # The bracket puts every target rank in [lt_lo, le_hi); raise_error
        # guards that guarantee instead of returning a wrong value.
        return (F.when((j >= F.col("lt_lo")) & (j < F.col("le_lo")), F.col("lo"))
                .when((j >= F.col("le_lo")) & (j < F.col("lt_hi")), m)
                .when((j >= F.col("lt_hi")) & (j < F.col("le_hi")), F.col("hi"))
                .otherwise(F.raise_error(F.lit("exact_quantiles: rank outside bracket")).cast("double")))

    v0 = value_at(F.col("j0"), F.col("m0"))
    v1 = value_at(F.col("j1"), F.col("m1"))
    res = res.select(*g, "i", (v0 + F.col("frac") * (v1 - v0)).alias("__q"))
    out = res.groupBy(*g).agg(*[F.max(F.when(F.col("i") == i, F.col("__q"))).alias(names[i]) for i in range(k)])
    ren = out.select(*[F.col(c).alias(f"__g{j}") for j, c in enumerate(g)], *map(quoted, names))
    keys = stats.select(*g, *map(quoted, extra_names))
    cond = [keys[c].eqNullSafe(ren[f"__g{j}"]) for j, c in enumerate(g)]
    out = keys.join(ren, cond, "left")
    return out.select(*[F.col(k).alias(c) for k, c in zip(g, user_g)], *map(quoted, [*names, *extra_names]))


def _bracket(offset, size, lo, hi, whole, grid: int):
    """New (lo, hi) around target ranks j0..j1 of a set of ``size`` values
    starting at rank ``offset`` from its ``__grid`` of approximate quantiles,
    two grid steps wide on each side; ``whole`` keeps (lo, hi)."""
    r0 = (F.col("j0") - offset).cast("double") / F.greatest(size, F.lit(1))
    r1 = (F.col("j1") - offset + 1).cast("double") / F.greatest(size, F.lit(1))
    i_lo = F.floor(r0 * grid).cast("int") - 2
    i_hi = F.ceil(r1 * grid).cast("int") + 2
    new_lo = F.when(whole | (i_lo < 0), lo).otherwise(F.element_at("__grid", i_lo + 1))
    new_hi = F.when(whole | (i_hi > grid), hi).otherwise(F.element_at("__grid", i_hi + 1))
    return new_lo.alias("lo"), new_hi.alias("hi")


def column_quantiles(df: DataFrame, columns: Mapping[str, Column], probs: Sequence[float], extra_aggs: Mapping | None = None,
                     accuracy: int = 10_000, max_inside: int = 100_000) -> dict[str, dict]:
    """Exact quantiles of many whole columns in two scans, without stacking rows or joining.

    Scan 1 aggregates every column side by side: its count, ``extra_aggs``, and
    the two sketched values that bracket each target rank (three sketch errors
    on either side).  Scan 2 counts what lies below, at and above the brackets
    and picks the ranks among the sorted values strictly inside.  A bracket
    holds at most 8 n / ``accuracy`` values; a column where that exceeds
    ``max_inside``, or whose bracket misses, goes to ``exact_quantiles``.

    Returns name -> {"n", "q": [...], extras...}: one small row per column.
    """
    probs = [float(p) for p in probs]
    if not columns:
        return {}
    names, margin = list(columns), 3.0 / accuracy
    value = {c: F.when(~F.isnan(v.cast("double")), v.cast("double")) for c, v in columns.items()}
    points = [x for p in probs for x in (max(0.0, p - margin), min(1.0, p + margin))]
    first = df.agg(*[F.struct(F.count(value[c]).alias("n"), F.percentile_approx(value[c], points, accuracy).alias("at"),
                              *[fn(value[c]).alias(name) for name, fn in (extra_aggs or {}).items()]).alias(f"c{i}")
                     for i, c in enumerate(names)]).collect()[0]
    out = {c: {"n": first[i]["n"], "q": [None] * len(probs), **{name: first[i][name] for name in (extra_aggs or {})}} for i, c in enumerate(names)}
    direct = [c for c in names if out[c]["n"] and 8 * out[c]["n"] <= max_inside * accuracy]
    aggs, picks, plan = [], [], []
    for c in direct:
        n, at, v = out[c]["n"], first[names.index(c)]["at"], value[c]
        for i, p in enumerate(probs):
            j = int((n - 1) * p)
            lo, hi = (float("-inf") if p <= margin else at[2 * i]), (float("inf") if p >= 1 - margin else at[2 * i + 1])
            k = len(plan)
            plan.append((c, i, j, min(j + 1, n - 1), (n - 1) * p - j, lo, hi))
            aggs += [F.count_if(v < lo).alias(f"a{k}"), F.count_if(v <= lo).alias(f"b{k}"), F.count_if(v < hi).alias(f"c{k}"), F.count_if(v <= hi).alias(f"d{k}"),
                     F.sort_array(F.collect_list(F.when((v > lo) & (v < hi), v))).alias(f"e{k}")]
            place = lambda rank: (F.lit(rank) - F.col(f"b{k}") + 1).cast("int")  # noqa: B023, E731
            picks += [f"a{k}", f"b{k}", f"c{k}", f"d{k}", *[F.when(place(r) >= 1, F.try_element_at(F.col(f"e{k}"), place(r))).alias(f"m{k}_{r == j}")
                                                            for r in {j, min(j + 1, n - 1)}]]
    row = df.agg(*aggs).select(*picks).collect()[0] if plan else None
    missed = [c for c in names if out[c]["n"] and c not in direct]
    for k, (c, i, j0, j1, frac, lo, hi) in enumerate(plan):
        def at_rank(j: int):
            if row[f"a{k}"] <= j < row[f"b{k}"]:  # noqa: B023
                return lo  # noqa: B023
            if row[f"b{k}"] <= j < row[f"c{k}"]:  # noqa: B023
                return row[f"m{k}_{j == j0}"]  # noqa: B023
            return hi if row[f"c{k}"] <= j < row[f"d{k}"] else None  # noqa: B023
        v0, v1 = at_rank(j0), at_rank(j1)
        if v0 is None or v1 is None:
            missed.append(c)
        else:
            out[c]["q"][i] = v0 + frac * (v1 - v0)
    for c in dict.fromkeys(missed):
        out[c]["q"] = exact_quantile_values(df.select(value[c].alias("v")), "v", probs, accuracy)
    return out


def exact_quantile_values(df: DataFrame, value_col: str, probs: Sequence[float],
                          accuracy: int = 10_000) -> list[float | None]:
    """Global exact quantiles as Python floats (a bounded, k-value result)."""
    row = exact_quantiles(df, value_col, probs, accuracy=accuracy).collect()[0]
    return [row[i] for i in range(len(probs))]


def mode_of(df: DataFrame, value_col: str, group_cols: Sequence[str] = (),
            out_col: str = "mode") -> DataFrame:
    """Most frequent non-null value per group; ties go to the smallest value."""
    g = [quoted(c) for c in group_cols]
    counted = df.where(quoted(value_col).isNotNull()).groupBy(*g, quoted(value_col).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    best = F.min(F.struct((-F.col("__c")).alias("neg"), F.col("__v").alias("v")))
    return counted.groupBy(*g).agg(best["v"].alias(out_col))


def mode_value(df: DataFrame, value_col: str):
    """Global mode as a Python value (None when the column is all NULL)."""
    row = mode_of(df, value_col).collect()
    return row[0]["mode"] if row else None

