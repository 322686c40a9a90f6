"""Dataset registry summary, computed from the tables (not hard-coded)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_summary(tables: Mapping[str, DataFrame], tasks: Mapping[str, str] | None = None) -> DataFrame:
    """One row per registered table: name, task, rows, columns.  Each row
    count is its own aggregate (metadata-only for plain Parquet scans)."""
    tasks = tasks or {}
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("name"), F.lit(tasks.get(name)).cast("string").alias("task"),
        F.col("rows").cast("bigint").alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"))
        for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
