"""Connected components of a link table by large-star / small-star rounds on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm import _common as C


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) with u > v.  The least neighbour of a node comes from an
    aggregate, not from its gathered neighbours, and is written before it is joined back:
    Spark splits the rows of a hot node only between two plain shuffles."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = C.materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = C.materialize(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = links.join(least, "u").select("v", "m").union(least.select("u", "m")).toDF("u", "v")
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node that isn't itself the least of its component.

    ``links`` holds pairs (u, v) of one orderable type, either way round.  Each round is
    written to the shared folder, so a lost executor costs one round at most.
    """
    state = C.materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        state = C.materialize(_star(_star(state, True), False), "links")
