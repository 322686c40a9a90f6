"""Centroid clustering of integer vectors by scalar lookup tables.

Vectors are turned into integers once and written.  Each round holds, for every dimension
and every integer value that occurs there, the squared difference to every centroid's
component; the distances of a batch are gathers from these tables, added up.  A task
tabulates a value when it first meets it and keeps the tables from batch to batch, at most
``ENTRIES`` values in all (more are tabulated anew, batch by batch).

Only the centroids travel: ``k`` x ``dim`` numbers to the tasks, and ``k`` rows of sums
back, added up by Spark with partial sums per task, so neither a hot cluster nor a vector
that a third of the rows share meets in one task.  Sums are decimals, so means are exact.
A round writes nothing; a lost executor costs its tasks of that round.

Vectors that are NULL, have another length, or hold a NULL, NaN or infinite component are
left out.  Repeated rows count each.  A NULL id stands last in the starting order, equal
hashes are ordered by their vectors.  With fewer vectors than ``k`` there are fewer
clusters; an empty table gives an empty result; other columns are ignored.  Components
beyond 64 bits after scaling, and distances beyond 64 bits, count as the largest long.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm import _common as C

K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
ENTRIES = 1 << 19  # tabulated values of a task, k squared differences each
ROWS = 1024  # vectors whose distances are added up at once
LARGEST = (1 << 63) - 1
PLAIN = 1 << 27  # components below this have sums of squared differences well inside 64 bits


def integers(vectors: DataFrame, id_col: str, vector_col: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of every usable vector."""
    v = C.quoted(vector_col)
    usable = (F.size(v) == dim) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return vectors.where(usable).select(C.quoted(id_col).alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Tables:
    """Squared differences of occurring values to the components of the centroids, by dimension."""

    def __init__(self, centroids: np.ndarray, entries: int = ENTRIES):
        self.centroids, self.entries = centroids, entries
        self.plain = not len(centroids) or np.abs(centroids.astype(object)).max() < PLAIN
        self.clear()

    def clear(self) -> None:
        k, dim = self.centroids.shape
        self.values = [np.zeros(0, np.int64) for _ in range(dim)]
        self.squares = [np.zeros((0, k), np.int64) for _ in range(dim)]
        self.built = 0

    def rows_of(self, d: int, x: np.ndarray) -> np.ndarray:
        """The table row of each value in dimension ``d``; values not met before are tabulated."""
        at = np.searchsorted(self.values[d], x)
        known = at < len(self.values[d])
        known[known] = self.values[d][at[known]] == x[known]
        if known.all():
            return at
        new = np.unique(x[~known])
        self.built += len(new)
        place = np.searchsorted(self.values[d], new)
        self.values[d] = np.insert(self.values[d], place, new)
        self.squares[d] = np.insert(self.squares[d], place, (new[:, None] - self.centroids[None, :, d]) ** 2, axis=0)
        return np.searchsorted(self.values[d], x)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each vector's nearest centroid (ties: the smaller number) and its squared distance."""
        if not self.plain or (np.abs(v.astype(float)) >= PLAIN).any():
            return self._wide(v)
        if self.built > self.entries:
            self.clear()
        at = np.stack([self.rows_of(d, v[:, d]) for d in range(v.shape[1])])
        label, best = np.zeros(len(v), np.int32), np.zeros(len(v), np.int64)
        most = sum(int(s.max()) for s in self.squares)
        squares = [s.astype(np.int32) for s in self.squares] if most < 1 << 31 else self.squares
        for i in range(0, len(v), ROWS):
            total = squares[0][at[0, i: i + ROWS]]
            for d in range(1, v.shape[1]):
                total += squares[d][at[d, i: i + ROWS]]
            label[i: i + ROWS] = total.argmin(1)
            best[i: i + ROWS] = total.min(1)
        return label, best

    def _wide(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors with huge components, in Python's integers, one by one."""
        label, best = np.zeros(len(v), np.int32), np.zeros(len(v), np.int64)
        centroids = self.centroids.astype(object)
        for i, row in enumerate(v.astype(object)):
            total = ((row - centroids) ** 2).sum(1)
            label[i] = min(range(len(total)), key=total.__getitem__)
            best[i] = min(total[label[i]], LARGEST)
        return label, best


def starting_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors of least sha256 of ``seed:id``, in the order of their hashes."""
    rows = vectors.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), len(rows[0].v) if rows else 0)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and exact component sums of every non-empty cluster."""
    k, dim = centroids.shape

    def run(batches):
        tables, n, sums = Tables(centroids), np.zeros(k, np.int64), np.zeros((k, dim), object)
        for batch in batches:
            v = matrix(batch.column(0), dim)
            if not len(v):
                continue
            label, _ = tables.nearest(v)
            order = np.argsort(label, kind="stable")
            here, first = np.unique(label[order], return_index=True)
            wide = v.astype(object) if np.abs(v.astype(float)).max() >= PLAIN else v
            sums[here] += np.add.reduceat(wide[order], first, axis=0).astype(object)
            n += np.bincount(label, minlength=k)
        used = np.flatnonzero(n)
        flat = pa.array([Decimal(x) for x in sums[used].ravel()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * dim), flat)],
                                         names=["cluster", "n", "sums"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dim))).collect()  # at most k rows
    return {r.cluster: (r.n, [int(r[f"s{d}"]) for d in range(dim)]) for r in rows}


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    centroids = starting_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        for cluster, (n, sums) in cluster_sums(vectors, centroids).items():
            centroids[cluster] = [s // n for s in sums]  # Python's // is the exact floor
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster and distance (squared) of every vector."""
    def run(batches):
        tables = Tables(centroids)
        for batch in batches:
            if batch.num_rows:
                label, best = tables.nearest(matrix(batch.column(1), centroids.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label), pa.array(best)], names=["id", "cluster", "distance"])

    return vectors.select("id", "v").mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, id_col: str = "id", vector_col: str = "vector", k: int = K, rounds: int = ROUNDS, dim: int = DIM,
                    scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The vectors with their clusters (id, cluster, distance), and the clusters themselves
    (cluster, centroid, cluster_inertia, inertia): at most k rows."""
    spark = vectors.sparkSession
    rows = C.materialize(integers(vectors, id_col, vector_col, dim, scale), "kmeans-vectors")
    centroids = fit(rows, k, rounds, seed)
    assigned = C.materialize(assign(rows, centroids), "kmeans-assigned")
    inertia = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    total = min(sum(inertia.values()), LARGEST)
    clusters = [(c, [int(x) for x in centroids[c]], min(inertia.get(c, 0), LARGEST), total) for c in range(len(centroids))]
    return assigned, spark.createDataFrame(clusters, "cluster int, centroid array<long>, cluster_inertia long, inertia long")


def op13_table_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, clusters = cluster_vectors(C.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    digests = clusters.select("cluster", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))
    # the clusters are at most K rows
    return assigned.join(F.broadcast(digests), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(i: int) -> str:
    """SQL of one round: every vector to its nearest centroid of round i, then the centroids of the next."""
    return f"""
k{i} AS MATERIALIZED (
  SELECT rid, min(key) AS key FROM (SELECT rid, sum((e.x - c.x) * (e.x - c.x)) * 64 + cid AS key FROM e JOIN c{i} c USING (d) GROUP BY rid, cid) GROUP BY rid),
c{i + 1} AS MATERIALIZED (
  SELECT cid, d, coalesce((s - ((s % n) + n) % n) // n, x)::BIGINT AS x
  FROM c{i} LEFT JOIN (SELECT (key % 64)::BIGINT AS cid, d, sum(x) AS s, count(*) AS n FROM e JOIN k{i} USING (rid) GROUP BY 1, 2) m USING (cid, d)),"""


ORACLE_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT rid, unnest(range(64)) AS d, unnest(q) AS x FROM v),
c0 AS MATERIALIZED (
  SELECT cid, unnest(range(64)) AS d, unnest(q) AS x
  FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, q) - 1 AS cid, q FROM v QUALIFY cid < 40)),{"".join(map(_round, range(ROUNDS + 1)))}
g AS (SELECT cid, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cid)
SELECT vec_id, (key % 64)::INTEGER AS cluster, (key // 64)::BIGINT AS distance, (sum(key // 64) OVER (PARTITION BY key % 64))::BIGINT AS cluster_inertia,
  (sum(key // 64) OVER ())::BIGINT AS inertia, centroid_sha256
FROM k{ROUNDS} JOIN v USING (rid) JOIN g ON g.cid = key % 64
"""
