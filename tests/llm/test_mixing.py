from collections import defaultdict

import duckdb
import pytest

from tableprep.llm import mixing

from ..conftest import SF001, SF0001


def reshared(sizes, weights, total, cap):
    """Targets by resharing the excess until no source is above its cap."""
    target, open_, left = {}, set(sizes), total
    while open_:
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def words(text):
    return len((text or "").encode().split())


@pytest.mark.parametrize("name", ["docs", "odd_docs"])
def test_targets_and_taken(request, name):
    df = request.getfixturevalue(name)
    rows = mixing.mix_plan(df).collect()
    assert len(rows) == df.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = reshared(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - want[s]) <= 0.5
    assert all(r.source_size == sizes[r.source] for r in rows)


def test_positions_follow_the_schedule(docs):
    """Words of a source placed before t are its schedule's integral up to t."""
    rows = mixing.mix_plan(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source] += [(c.position, c.words) for c in r.copies if c.words]
    for i, s in enumerate(sorted(by)):
        front, back = mixing.SCHEDULES[i % 3]
        total, big = sum(w for _, w in by[s]), max(w for _, w in by[s])
        for t in (0.25, 0.5, 0.75):
            assert abs(sum(w for p, w in by[s] if p <= t) - total * (front * t + (back - front) * t * t / 2)) <= big


def test_mixed_documents_are_sorted_and_cut(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        mixed = mixing.mix_documents(df)
        assert mixed.columns == [*df.columns, "position", "epoch"]
        got = mixed.collect()
        assert [r.position for r in got] == sorted(r.position for r in got)
        taken = defaultdict(int)
        for r in got:
            taken[r.doc_id] += words(r.text)
        want = defaultdict(int)
        for r in mixing.mix_plan(df).collect():
            want[r.doc_id] += r.taken
        assert {k: v for k, v in want.items() if v} == dict(taken)
    assert mixing.mix_documents(no_docs).collect() == []
    assert mixing.mix_plan(no_docs).collect() == []


@pytest.mark.parametrize("sf", [SF0001, SF001])
def test_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    rel = con.sql(mixing.ORACLE_SQL)
    df = mixing.op8_curriculum_mix(spark, sf)
    norm = lambda rows, cols: sorted(tuple((c, round(v, 9) if isinstance(v, float) else v) for c, v in sorted(zip(cols, r))) for r in rows)
    assert str(norm([tuple(r) for r in df.collect()], df.columns)) == str(norm(rel.fetchall(), rel.columns))
