import hashlib
import math

import numpy as np
import pytest

from tableprep.llm import table_kmeans as M


def plain(rows, k, rounds, dim):
    """Lloyd's rounds in Python's integers, vector by vector."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs)]
    return sorted((str(i), n, d) for i, v in kept for d, n in [nearest(v)]), centroids


def run(spark, rows, **settings):
    df = spark.createDataFrame(rows, "id long, vector array<double>").selectExpr("*", "1 AS v", "'x' AS cluster", "2 AS distance")
    assigned, clusters = M.cluster_vectors(df, **settings)
    return sorted((str(r.id), r.cluster, r.distance) for r in assigned.collect()), clusters.orderBy("cluster").collect()


@pytest.mark.parametrize("n, dim, k, spread", [(400, 5, 12, 3.0), (300, 3, 40, 0.01), (7, 4, 10, 1.0), (250, 2, 6, 5000.0)])
def test_against_plain_integers(spark, n, dim, k, spread):
    rng = np.random.default_rng(n)
    rows = [(int(i), (rng.normal(size=dim) * spread).tolist()) for i in rng.permutation(n)]
    rows += [rows[0]] * 9 + [(rows[1][0], rows[2][1])] * 3  # repeated rows and ids
    rows += [(5000, None), (5001, []), (5002, [1.0] * (dim + 1)), (5003, [None] * dim), (5004, [float("nan")] * dim), (5005, [float("-inf")] * dim), (None, [0.5] * dim), (None, [0.25] * dim)]
    got, clusters = run(spark, rows, k=k, rounds=4, dim=dim)
    want, centroids = plain(rows, k, 4, dim)
    assert got == want
    assert [r.centroid for r in clusters] == centroids
    assert {r.inertia for r in clusters} == {sum(d for _, _, d in want)}
    assert [r.cluster_inertia for r in clusters] == [sum(d for _, c, d in want if c == i) for i in range(len(centroids))]


def test_huge_components(spark):
    rows = [(i, [x, -x]) for i, x in enumerate([0.0, 1.0, 1e6, 3e6, 5e6, 1e5, -2e6, 7.0])]
    got, clusters = run(spark, rows, k=3, rounds=3, dim=2)
    want, centroids = plain(rows, 3, 3, 2)
    assert got == want and [r.centroid for r in clusters] == centroids
    got, _ = run(spark, [(1, [1e300]), (2, [-1e300]), (3, [0.0])], k=1, rounds=1, dim=1)
    assert len(got) == 3 and max(d for _, _, d in got) == M.LARGEST


def test_a_vector_that_a_third_share_and_empty_clusters(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [float(i % 7), float(i % 5)]) for i in range(600)]
    got, clusters = run(spark, rows, k=20, rounds=5, dim=2)
    want, centroids = plain(rows, 20, 5, 2)
    assert got == want and [r.centroid for r in clusters] == centroids


def test_tables_stay_bounded_and_hold_only_occurring_values():
    rng = np.random.default_rng(3)
    centroids = rng.integers(-900, 900, (6, 3))
    tables = M.Tables(centroids, entries=200)
    for _ in range(30):
        v = rng.integers(-10_000, 10_000, (40, 3))
        label, best = tables.nearest(v)
        d = ((v[:, None] - centroids) ** 2).sum(2)
        assert (label == d.argmin(1)).all() and (best == d.min(1)).all()
        assert tables.built <= 200 + 3 * 40
    for d in range(3):
        assert set(v[:, d]) <= set(tables.values[d])


def test_empty_table(spark):
    assert run(spark, [], k=4) == ([], [])
    assert run(spark, [(1, None), (2, [1.0])], k=4) == ([], [])
