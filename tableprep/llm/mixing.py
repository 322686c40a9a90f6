"""Mixing sources to target weights with a time-varying curriculum.  DataFrame functions only.

Each source has a weight and a schedule, how that weight is spread over the training run:
``front + (back - front) * t`` for t from 0 to 1.  Its integral is the source's cumulative
demand, ``target * (front * t + (back - front) * t^2 / 2) / ((front + back) / 2)``.  The
documents of a source, in the order of a hash, are passed over again and again (at most
``max_epochs`` times) until its target is met; each copy stands where the demand reaches
the middle of its words, which is the schedule's integral inverted at that count.  The
last copy that a source needs is cut to the words still missing, so that the words taken
equal the target rounded to whole words.

Targets: ``share`` times all words, dealt by weight; a source stops at ``max_epochs``
times its own size and the excess goes to the others by weight, until none is above.

Results depend on the rows alone (md5 order), so reruns agree.  NULL or empty texts have
size 0 and take 0; a NULL source is a source of its own, last in order; repeated rows
are drawn each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableprep.llm import _common as C

WEIGHTS = (3.0, 1.0, 2.0)
#: (front, back) of the schedules, repeating as the weights do: even, rising, falling.
SCHEDULES = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))
SHARE, MAX_EPOCHS, BUCKETS = 1.5, 2, 4096


def source_targets(sizes: DataFrame, share: float, max_epochs: int, weights: Sequence[float], schedules: Sequence[tuple[float, float]]) -> DataFrame:
    """source, source_size, target, front, back; one row per source (``sizes``: source, size)."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = (F.row_number().over(named) - 1)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    per = per.select("source", "source_size", pick(list(weights)).alias("weight"),
                     pick([a for a, _ in schedules]).alias("front"), pick([b for _, b in schedules]).alias("back"),
                     (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap"))
    # the sources that stop at their cap are those of the least cap per weight: find where that ends
    tightest = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, all_ = tightest.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    per = (per.withColumn("room", F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
           .withColumn("rest", F.sum("weight").over(tightest.rowsBetween(0, Window.unboundedFollowing)))
           .withColumn("level", F.when(F.col("room") * F.col("weight") <= F.col("cap") * F.col("rest"), F.col("room") / F.col("rest"))))
    level = F.max("level").over(all_)
    return per.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"), "front", "back")


def position_of(words: Column, target: Column, front: Column, back: Column) -> Column:
    """Where in [0, 1] the cumulative demand of a source reaches ``words``."""
    part = F.least(F.lit(1.0), words / target) * (front + back)  # = 2 * front * t + (back - front) * t^2
    rise = back - front
    # the root in the form that holds for a rise of 0 too
    return F.least(F.lit(1.0), part / (front + F.sqrt(F.greatest(F.lit(0.0), front * front + rise * part))))


def mix_plan(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: Sequence[float] = WEIGHTS,
             schedules: Sequence[tuple[float, float]] = SCHEDULES, buckets: int = BUCKETS, with_row: bool = False) -> DataFrame:
    """One row per document: size, source_size, target, taken, and ``copies`` (epoch, words, position);
    ``row`` holds the document's own columns if asked for."""
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))))
    order = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    kept = ["row"] * with_row
    rows = docs.select("doc_id", "source", *[F.struct(*map(C.quoted, docs.columns)).alias(c) for c in kept], C.word_count("text").alias("size"), order.alias("h"))
    rows = rows.withColumn("bucket", F.expr(f"h div {(1 << 60) // buckets}"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(sums, share, max_epochs, weights, schedules)
    # words of a source before each hash bucket: `buckets` rows per source, however large it is
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    marks = before.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    marks = marks.withColumnsRenamed({"source": "s", "bucket": "b"})
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(marks, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("first", F.col("base") + F.col("inside"))
    goal = F.round("target").cast("long")

    def copy(epoch: int) -> Column:
        start = F.col("first") + epoch * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), goal - start))
        return F.struct(F.lit(epoch).alias("epoch"), words.cast("long").alias("words"),
                        F.when(words > 0, position_of(start + words / 2, F.col("target"), F.col("front"), F.col("back"))).alias("position"))

    rows = rows.withColumn("copies", F.array(*(copy(e) for e in range(max_epochs))))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return rows.select("doc_id", "source", "h", *kept, "size", "source_size", "target", taken.alias("taken"), "copies")


def leading_words(text: str, n: str) -> Column:
    """The text up to the end of its n-th word, white space as it stands."""
    parts = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    return F.array_join(F.slice(parts, F.lit(1), F.col(n).cast("int")), "")


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each copy taken, with the columns of ``docs``, range-sorted by position.
    ``position`` and ``epoch`` follow them, with underscores after where ``docs`` has such columns."""
    copies = mix_plan(docs, with_row=True, **settings).select("row", "h", "size", F.explode("copies").alias("copy")).where("copy.words > 0")
    cut = F.when(F.col("copy.words") < F.col("size"), leading_words("row.text", "copy.words")).otherwise(F.col("row.text"))
    placed = copies.repartitionByRange("copy.position", "h").sortWithinPartitions("copy.position", "h")
    return placed.select(*(cut.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns),
                         F.col("copy.position").alias(C.fresh("position", docs.columns)), F.col("copy.epoch").alias(C.fresh("epoch", docs.columns)))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(C.table(spark, sf_dir, "documents"))
    positions = F.transform("copies", lambda c: c["position"])
    rows = plan.select("doc_id", "size", "source_size", "target", "taken", positions[0].alias("position"), positions[1].alias("position_again"), "h")
    return rows.repartitionByRange("position", "h").sortWithinPartitions("position", "h").drop("h")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0 * sum(size) AS cap,
    [3.0, 1.0, 2.0][(row_number() OVER o - 1) % 3 + 1]::DOUBLE AS weight, [1.0, 0.5, 1.5][(row_number() OVER o - 1) % 3 + 1]::DOUBLE AS front
  FROM d GROUP BY source WINDOW o AS (ORDER BY source NULLS LAST)),
r AS (
  SELECT *, 1.5 * (SELECT sum(size) FROM d) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s),
l AS (SELECT max(room / rest) AS level FROM r WHERE room * weight <= cap * rest),
t AS (SELECT source, source_size, least(cap, level * weight)::DOUBLE AS target, front, 2.0 - front AS back FROM s, l),
c AS (
  SELECT doc_id, size, source_size, target, front, back, round(target)::BIGINT AS goal,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
w AS (
  SELECT *, greatest(0, least(size, goal - first)) AS w0, greatest(0, least(size, goal - first - source_size)) AS w1,
    least(1.0, (first + w0 / 2) / target) * 2.0 AS p0, least(1.0, (first + source_size + w1 / 2) / target) * 2.0 AS p1, back - front AS rise FROM c)
SELECT doc_id, size, source_size, target, (w0 + w1)::BIGINT AS taken,
  CASE WHEN w0 > 0 THEN least(1.0, p0 / (front + sqrt(greatest(0.0, front * front + rise * p0)))) END AS position,
  CASE WHEN w1 > 0 THEN least(1.0, p1 / (front + sqrt(greatest(0.0, front * front + rise * p1)))) END AS position_again
FROM w
"""
