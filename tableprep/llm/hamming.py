"""Exact top-k search of binary codes by incremental multi-index hashing.

Codes are the signs of the vectors' components, one bit each, packed into 64-bit words.
Equal codes are one class that keeps its ``k`` least ids, so no group of copies is ever
paired with itself.  The classes lie in index blocks, spread by hash; a block has one
table per 16-bit segment of the code.  For each query the segments are probed in turn with
all values at radius 0, then 1, 2, ...; once the first j of m segments have been probed at
radius r, every code within ``m * r + j - 1`` bits has been met, so a query is done as soon
as its k-th verified distance is no larger.  Each block hands on its own k best classes
per query, and Spark merges those.

Queries are the stated set of rows (ids divisible by ``every``), in chunks; each chunk
meets every block by an equi-join on the block number.  There are as few chunks as give
every task work (more only where one would pass ``CHUNK`` codes), tasks get runs of pairs
in the order of their blocks, and a task indexes a block once for all its chunks.

A row without id or vector is neither query nor answer; a NULL or NaN component counts as
a 0 bit, shorter vectors are filled up with 0 bits; repeated rows are answers each, ties
go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableprep.llm import _common as C

K, EVERY = 10, 20
SEGMENT = 16
BLOCK_CODES, CHUNK, LEAST_CHUNK = 1 << 16, 1 << 16, 256
STEP = 64  # queries probed at once


def binary_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and code (little-endian 64-bit words) of every row that has both."""
    def run(batches):
        for batch in batches:
            arr = batch.column(1)
            n = np.diff(arr.offsets.to_numpy(zero_copy_only=False))
            flat = arr.flatten().fill_null(0).to_numpy(zero_copy_only=False)
            bits = np.zeros((len(n), width), bool)
            bits[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = flat > 0
            packed = np.packbits(bits, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes() for p in packed], pa.binary())], names=["id", "code"])

    rows = vectors.where(C.quoted(id_col).isNotNull() & C.quoted(vector_col).isNotNull()).select(C.quoted(id_col).cast("long").alias("id"), C.quoted(vector_col).alias("v"))
    width = 64 * max(1, -(-int(rows.agg(F.max(F.size("v"))).first()[0] or 1) // 64))
    return rows.mapInArrow(run, "id long, code binary")


@lru_cache(maxsize=None)
def flips(radius: int) -> np.ndarray:
    """All segment values with ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), radius)], np.int64)


class Index:
    """Segment tables of one block of distinct codes."""

    def __init__(self, codes: np.ndarray, first_ids: np.ndarray):
        self.codes, self.first_ids = codes, first_ids  # (n, words) and the least id of each class
        self.parts = codes.view("<u2").reshape(len(codes), -1).astype(np.int64)
        self.order = np.argsort(self.parts, axis=0, kind="stable")
        self.starts = [np.searchsorted(self.parts[self.order[:, s], s], np.arange((1 << SEGMENT) + 1)) for s in range(self.parts.shape[1])]

    def probe(self, values: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose segment has one of the values (one row of values per query), with the query's number."""
        starts = self.starts[segment]
        a, n = starts[values], starts[values + 1] - starts[values]
        total = int(n.sum())
        rows = np.repeat(a.ravel() - (np.cumsum(n.ravel()) - n.ravel()), n.ravel()) + np.arange(total)
        return np.repeat(np.arange(len(values)), n.sum(1)), self.order[rows, segment]

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of each query's k best classes, by distance and then least id."""
        parts = queries.view("<u2").reshape(len(queries), -1).astype(np.int64)
        m, n = parts.shape[1], len(self.codes)
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        todo = np.arange(len(queries))
        for radius in range(SEGMENT + 1):
            for s in range(m):
                q, row = self.probe(parts[todo, s][:, None] ^ flips(radius)[None, :], s)
                q = todo[q]
                key = np.unique(np.concatenate([best[0], q]) * n + np.concatenate([best[1], row]))
                q, row = key // n, key % n
                dist = np.bitwise_count(queries[q] ^ self.codes[row]).sum(1).astype(np.int64)
                keep = np.lexsort((self.first_ids[row], dist, q))
                q, row, dist = q[keep], row[keep], dist[keep]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                best = q[place < k], row[place < k], dist[place < k]
                # every code within this many bits has been met by now
                covered = m * radius + s
                last = np.full(len(queries), np.iinfo(np.int64).max)
                full = (place == min(k, n) - 1)
                last[q[full]] = dist[full]
                todo = todo[last[todo] > covered]
                if not len(todo):
                    return best
        return best


def top_k(vectors: DataFrame, id_col: str = "id", vector_col: str = "vector", k: int = K, every: int = EVERY, block_codes: int = BLOCK_CODES) -> DataFrame:
    """query_id, rank (from 1), match_id, distance: the k nearest rows of every query, the query's own row included."""
    spark = vectors.sparkSession
    coded = C.materialize(binary_codes(vectors, id_col, vector_col), "codes")
    by_code = Window.partitionBy("code").orderBy("id", "twin")
    # a rank limit, which Spark applies before the shuffle too, so a code that a third of the rows share stays small
    numbered = coded.withColumn("twin", F.monotonically_increasing_id()).withColumn("at", F.row_number().over(by_code)).where(F.col("at") <= k)
    classes = C.materialize(numbered.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "code-classes")
    blocks = max(1, -(-classes.count() // block_codes))
    packed = classes.groupBy(F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.col("ids")[0].alias("first"), "code"))).alias("rows"))
    asked = coded.where(F.pmod("id", F.lit(every)) == 0)
    questions = asked.select("code").distinct()
    # the work of a pair outweighs its bytes, so the pairs are dealt out by number, not by size
    tasks, n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))), questions.count()
    n_chunks = max(1, -(-n // CHUNK), min(-(-tasks // blocks), n // LEAST_CHUNK))
    chunk = F.pmod(F.xxhash64("code", F.lit(1)), F.lit(n_chunks))
    chunks = questions.groupBy(chunk.alias("chunk")).agg(F.sort_array(F.collect_list("code")).alias("queries"))
    # every chunk of the stated query set goes to every block
    sent = chunks.select("chunk", "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    met = C.materialize(packed, "code-blocks").join(C.materialize(sent, "code-queries"), "block")
    dealt = F.floor((F.col("block") * n_chunks + F.col("chunk")) * F.lit(tasks) / F.lit(blocks * n_chunks)).cast("int")
    met = met.withColumn("task", dealt).repartitionById(tasks, F.col("task")).sortWithinPartitions("block", "chunk").select("block", "rows.first", "rows.code", "queries")

    def run(batches):
        indexed = None
        for batch in batches:
            for i in range(batch.num_rows):
                block, queries = batch.column(0)[i].as_py(), batch.column(3)[i].as_py()
                if block != indexed:
                    first, codes = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                    words = len(codes[0]) // 8
                    table, indexed = Index(np.frombuffer(b"".join(codes), "<u8").reshape(-1, words), np.array(first, np.int64)), block
                asked_codes = np.frombuffer(b"".join(queries), "<u8").reshape(-1, words)
                for j in range(0, len(queries), STEP):
                    q, row, dist = table.search(asked_codes[j: j + STEP], k)
                    yield pa.RecordBatch.from_arrays([pa.array([queries[j + x] for x in q], pa.binary()), pa.array([codes[x] for x in row], pa.binary()), pa.array(dist)],
                                                     names=["query", "code", "distance"])

    near = met.mapInArrow(run, "query binary, code binary, distance long")
    # of the classes met, k in all are enough: each holds at least one id
    first_k = Window.partitionBy("query").orderBy("distance", F.col("ids")[0])
    near = near.join(classes, "code").withColumn("at", F.row_number().over(first_k)).where(F.col("at") <= k)
    ranked = near.select("query", "distance", F.explode("ids").alias("match_id"), F.monotonically_increasing_id().alias("twin"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "match_id", "twin"))).where(F.col("rank") <= k)
    answers = C.materialize(ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "match_id", "distance"))).alias("found")), "answers")
    return (asked.join(answers, asked["code"] == answers["query"]).select(F.col("id").alias("query_id"), F.explode("found").alias("f"))
            .select("query_id", "f.rank", "f.match_id", "f.distance"))


def op6_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(C.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


ORACLE_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
b AS (SELECT vec_id, list_aggregate(bits, 'string_agg', '')::BIT AS code FROM c),
d AS (SELECT q.vec_id AS query_id, a.vec_id AS match_id, bit_count(xor(q.code, a.code))::BIGINT AS distance FROM b q, b a WHERE q.vec_id % 20 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, match_id))::INTEGER AS rank FROM d)
SELECT query_id, rank, match_id, distance FROM r WHERE rank <= 10
"""
