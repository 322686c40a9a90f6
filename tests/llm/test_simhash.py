import numpy as np
import pytest
import xxhash

from tableprep.llm import simhash

from ..conftest import SF001


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=3):
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= distance):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_whole_table_against_brute_force(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    fps = [brute_fingerprint(r.text) for r in rows]
    roots = brute_components(fps)
    want = {r.doc_id: (f"{fp:016x}", rows[k].doc_id) for r, fp, k in zip(rows, fps, roots)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash_groups(spark, SF001).collect()}
    assert got == want


@pytest.mark.parametrize("leaf, node", [(128, 4096), (4, 16)])
def test_links_of_crowded_fingerprints(spark, monkeypatch, leaf, node):
    """Many fingerprints with one front, in small leaves and nodes: no component is lost or made up."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "NODE", node)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = set(rng.integers(0, 1 << 63, 300, dtype=np.uint64).tolist())
    for b in base:
        for _ in range(120):
            x = int(b)
            for bit in rng.choice(40, rng.integers(0, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long").repartition(5)
    signed = df.selectExpr("fp", "fp AS doc_id")
    got = {np.int64(r.fp).view(np.uint64): r.root for r in simhash.groups(signed).collect()}
    roots = brute_components(fps)
    by_brute, by_spark = {}, {}
    for f, r in zip(fps, roots):
        by_brute.setdefault(r, set()).add(f)
        by_spark.setdefault(got[np.uint64(f)], set()).add(f)
    assert sorted(map(sorted, by_brute.values())) == sorted(map(sorted, by_spark.values()))


def test_nodes_in_a_task_are_pruned_and_compared():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 1 << 20, 300, dtype=np.uint64))
    b = np.sort(a[:200] ^ (np.uint64(1) << rng.integers(0, 24, 200, dtype=np.uint64)))
    out = []
    simhash.compare(simhash.Node(a), simhash.Node(b), 3, out)
    got = {frozenset(map(int, p)) for p in np.concatenate(out, 1).T}
    linked = {int(x) for p in got for x in p}
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= 3
    assert linked == set(a[near.any(1)].tolist()) | set(b[near.any(0)].tolist())


def test_odd_rows_and_one_row_of_each_group(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == len(rows)
    fps = [brute_fingerprint(r.text) for r in rows]
    assert sorted(np.int64(f.fp).view(np.uint64) for f in found) == sorted(map(np.uint64, fps))
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len(set(brute_components(fps)))
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.keep_one(no_docs).collect() == []
