import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableprep.llm import doc_stats, quality, quality_rules, toxicity, trees

from ..conftest import SF001

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """The five base statistics, word by word."""
    text = text or ""
    words = WORDS.findall(text)
    grams = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    seen, inside, lines, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            inside |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab é\n\t|#\x0b\x1c\xa0"), max_size=60), st.text(max_size=20)), max_size=5))
def test_base_statistics(texts):
    got = doc_stats.measure(pa.array(texts, pa.string()))
    assert [tuple(int(got[c][i]) for c in doc_stats.BASE) for i in range(len(texts))] == [base(t) for t in texts]
    assert np.isfinite(doc_stats.features(got)).all()


def test_trees_match_a_walk_row_by_row():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = trees.boost(x, y)

    def walk(row):
        total = model.base
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return total

    assert np.allclose(model.sums(x), [walk(r) for r in x])
    assert ((model.probability(x) > 0.5) == y).mean() > 0.97
    forest = trees.bag(x, y)
    assert ((forest.mean(x) > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("sign", [1, -1])
def test_monotonic_constraint_holds(sign):
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(600, 3))
    y = (np.sin(9 * x[:, 0]) + 0.3 * rng.normal(size=600) > 0).astype(float)  # the labels themselves aren't monotonic
    model = trees.boost(x, y, monotone={0: sign})
    grid = np.linspace(0, 1, 101)
    for row in x[:40]:
        line = np.tile(row, (101, 1))
        line[:, 0] = grid
        assert (sign * np.diff(model.sums(line)) >= -1e-9).all()


def test_no_or_one_class():
    x = np.zeros((0, 3))
    assert trees.boost(x, np.zeros(0)).probability(np.ones((2, 3))).tolist() == [0.5, 0.5]
    assert (trees.boost(np.ones((5, 3)), np.ones(5)).probability(np.ones((2, 3))) > 0.5).all()


def rows_of(spark, name):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF001}/{name}.parquet").collect()}


def test_op3_on_held_out_labels(spark):
    docs, labels = rows_of(spark, "documents"), rows_of(spark, "labels")
    got = {r.doc_id: r for r in quality.op3_quality_gbdt(spark, SF001).collect()}
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())
    test = [(labels[i].quality, got[i].predicted) for i in labels if got[i].held_out]
    assert sum(a == b for a, b in test) >= 0.97 * len(test)


def test_op9_base_and_verdict(spark):
    docs, labels = rows_of(spark, "documents"), rows_of(spark, "labels")
    got = {r.doc_id: r for r in quality_rules.op9_quality_rules(spark, SF001).collect()}
    for i, d in docs.items():
        r = got[i]
        assert tuple(r[c] for c in doc_stats.BASE) == base(d.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    judged = [(labels[i].quality, got[i].kept) for i in labels if not got[i].base_failed]
    assert sum(a == b for a, b in judged) >= 0.97 * len(judged)


def test_rules_fall_with_their_features(docs, spark):
    model = quality_rules.fit_rules(docs, spark.read.parquet(f"{SF001}/labels.parquet"))
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(50, len(doc_stats.FEATURES))) * 3
    for f in quality_rules.FALLING:
        more = x.copy()
        more[:, doc_stats.FEATURES.index(f)] += rng.uniform(size=50)
        assert (model.sums(more) <= model.sums(x) + 1e-9).all()


def test_op10_on_held_out_labels(spark):
    docs, labels = rows_of(spark, "documents"), rows_of(spark, "labels")
    got = {r.doc_id: r for r in toxicity.op10_toxicity_ftrl(spark, SF001).collect()}
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())
    test = [(labels[i].toxic, got[i].predicted) for i in labels if got[i].held_out]
    assert sum(b for a, b in test if not a) <= 0.02 * len(test)  # clean documents are left alone
    assert sum(b for a, b in test if a) >= 0.5 * sum(a for a, _ in test)  # from 33 toxic training rows


def brute_slots(text):
    """Slots of one text, word by word in plain integers."""
    M = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
        x = (x ^ x >> 27) * 0x94D049BB133111EB & M
        return x ^ x >> 31

    words, run = [], b""
    for b in (text or "").encode() + b" ":
        if chr(b).isascii() and chr(b).isalnum() or b >= 128:
            run += bytes([b]).lower()
        elif run:
            words.append(run)
            run = b""
    total = lambda w: sum((mix(b + 1) | 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(w)) & M
    h = [mix(total(w)) for w in words]
    out = h + [mix(a * 3 + mix(b) + 1 & M) for a, b in zip(h, h[1:])] + [mix(a * 5 + mix(b) + 2 & M) for a, b in zip(h, h[2:])]
    out += [mix(total(w[:k]) + k & M) for k in toxicity.STEMS for w in words if len(w) > k]
    return sorted({x >> 64 - toxicity.BITS for x in out})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("abcXYZ019 é.,\n-"), max_size=50)), max_size=5))
def test_slots_of_a_batch(texts):
    got = toxicity.features(pa.array(texts, pa.string()))
    assert [g.tolist() for g in got] == [brute_slots(t) for t in texts]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.where("doc_id > 99")
    for run in (quality.classify, quality_rules.judge, toxicity.classify):
        for some in (labels, none):
            rows = run(odd_docs, some).collect()
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd_docs.collect())
            assert all(0 <= r.score <= 1 and (some is labels or r.score == pytest.approx(0.5)) for r in rows)
        assert run(no_docs, labels).collect() == []
    model = quality.fit_quality(odd_docs, labels)
    kept = quality.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()
    assert quality.keep_good(no_docs, model).collect() == []


def test_slots_are_hashed_in_bounded_memory():
    texts = pa.array([None, *["The same few words, said again. " * 30] * 4000, ""])  # 4 MB
    tracemalloc.start()
    try:
        got = toxicity.features(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 << 20
    assert not len(got[0]) and not len(got[-1]) and {tuple(g) for g in got[1:-1]} == {tuple(brute_slots(texts[1].as_py()))}


def test_training_rows_in_their_turn():
    rows = [("b", [1, 2], 1.0), ("a", [9], 0.0), ("b", [1], 1.0), ("a", [9], 1.0), ("a", [], 0.0)]
    parts = [pa.table({"turn": [t for t, _, _ in p], "slots": pa.array([np.array(s, "<u4").tobytes() for _, s, _ in p], pa.binary()), "y": [y for _, _, y in p]})
             for p in (rows[:2], rows[2:])]
    assert [(s.tolist(), y) for s, y in toxicity.Rows(pa.concat_tables(parts))] == [(s, y) for _, s, y in sorted(rows)]
