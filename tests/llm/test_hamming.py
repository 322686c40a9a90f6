import os

import duckdb
import numpy as np
import pytest

from tableprep.llm import hamming

from ..conftest import SF001


def brute(rows, k, every):
    width = max((len(v) for _, v in rows if v is not None), default=1)
    code = {}
    kept = [(i, [1 if x is not None and x > 0 else 0 for x in v] + [0] * (width - len(v))) for i, v in rows if i is not None and v is not None]
    ids, bits = [i for i, _ in kept], np.array([b for _, b in kept], bool).reshape(len(kept), -1)
    for i, b in zip(ids, bits):
        if i % every == 0:
            d = (bits ^ b).sum(1)
            code.setdefault(i, []).append([(r + 1, ids[j], int(d[j])) for r, j in enumerate(sorted(range(len(ids)), key=lambda j: (d[j], ids[j]))[:k])])
    return sorted((i, *a) for i, lists in code.items() for found in lists for a in found)


def test_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF001}/embeddings.parquet')")
    want = sorted(con.sql(hamming.ORACLE_SQL).fetchall())
    got = hamming.op6_hamming_topk(spark, SF001)
    assert sorted(map(tuple, got.select("query_id", "rank", "match_id", "distance").collect())) == want


@pytest.mark.parametrize("n, dim, block", [(700, 64, 100), (300, 130, 1 << 16), (40, 3, 7), (3, 64, 10)])
def test_against_brute_force(spark, n, dim, block):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(12, dim))
    rows = [(int(i), (base[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0, 0.3, 3])).tolist()) for i in range(n)]
    rows += [(5, rows[0][1]), (20, None), (None, rows[1][1]), (40, [None] + rows[0][1][1:]), (60, [float("nan")] * 2), (80, []), rows[0]]
    df = spark.createDataFrame(rows, "id long, vector array<double>").selectExpr("*", "id AS rank", "'x' AS code")
    got = sorted(map(tuple, hamming.top_k(df, k=5, block_codes=block).select("query_id", "rank", "match_id", "distance").collect()))
    assert got == brute(rows, 5, 20)


def test_copies_and_empty(spark):
    rows = [(i, [1.0, -1.0]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    assert sorted(map(tuple, hamming.top_k(df, k=3).select("query_id", "rank", "match_id", "distance").collect())) == brute(rows, 3, 20)
    assert hamming.top_k(df.where("id < 0")).collect() == []


def test_a_task_indexes_a_block_once(spark, tmp_path, monkeypatch):
    """Builds are counted in files, by block and task: one for each block of a task, however many chunks meet it."""
    folder = str(tmp_path)

    class Counted(hamming.Index):
        def __init__(self, codes, first_ids):
            import os
            import uuid

            from pyspark import TaskContext

            with open(os.path.join(folder, f"{codes[0].tobytes().hex()}-{len(codes)}-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"), "w"):
                super().__init__(codes, first_ids)

    monkeypatch.setattr(hamming, "Index", Counted)
    monkeypatch.setattr(hamming, "LEAST_CHUNK", 8)
    monkeypatch.setattr(hamming, "CHUNK", 16)
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.normal(size=64).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = sorted(map(tuple, hamming.top_k(df, k=3, every=5, block_codes=1000).select("query_id", "rank", "match_id", "distance").collect()))
    assert got == brute(rows, 3, 5)
    builds = [name.rsplit("-", 2)[:2] for name in os.listdir(folder)]
    assert builds and len(builds) == len(set(map(tuple, builds)))  # no block twice in a task
    assert len({b[0] for b in builds}) == 3 and len(builds) <= 3 + max(8, spark.sparkContext.defaultParallelism)
