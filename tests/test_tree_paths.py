import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableprep.ml import tree_paths as T


def expected(tree, i, x, known):
    """Output of a tree that follows the known features and averages over the others by cover."""
    n = tree[i]
    if n["leftChild"] < 0:
        return n["prediction"]
    left = x[n["featureIndex"]] in n["leftCategoriesOrThreshold"] if n["numCategories"] >= 0 else x[n["featureIndex"]] <= n["leftCategoriesOrThreshold"][0]
    if n["featureIndex"] in known:
        return expected(tree, n["leftChild"] if left else n["rightChild"], x, known)
    return sum(tree[c]["rawCount"] / n["rawCount"] * expected(tree, c, x, known) for c in (n["leftChild"], n["rightChild"]))


def brute(trees, weights, x):
    """Shapley values over all subsets of features, and the base value."""
    def value(s):
        return sum(w * expected(t, 0, x, s) for t, w in zip(trees, weights))

    d, phi = len(x), np.zeros(len(x))
    for i in range(d):
        for k in range(d):
            for s in itertools.combinations([j for j in range(d) if j != i], k):
                phi[i] += math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) * (value({*s, i}) - value(set(s)))
    return phi, value(set())


def grow(rng, depth, d, count=4096):
    """A random tree as rows of a node table, features repeated along paths, feature 0 categorical."""
    tree = {}

    def node(level, count):
        i = len(tree)
        tree[i] = n = {"prediction": float(rng.normal()), "rawCount": count, "leftChild": -1, "rightChild": -1, "featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}
        if level < depth and count > 1 and rng.random() < 0.93:
            f, here = int(rng.integers(d)), int(rng.integers(1, count))
            n["featureIndex"] = f
            n["numCategories"] = 4 if f == 0 else -1
            n["leftCategoriesOrThreshold"] = rng.permutation(4)[: rng.integers(1, 4)].astype(float).tolist() if f == 0 else [float(rng.integers(0, 4)) + 0.5]
            n["leftChild"] = node(level + 1, here)
            n["rightChild"] = node(level + 1, count - here)
        return i

    node(0, count)
    return tree


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(0, 7), st.integers(1, 5), st.integers(0, 3), st.sampled_from([(12, 1 << 28), (2, 1 << 28), (12, 300)]))
def test_against_all_subsets(seed, depth, d, stump, limits):
    rng = np.random.default_rng(seed)
    trees, weights = [grow(rng, depth, d) for _ in range(3)], [1.0, 0.1, -0.5]
    x = rng.integers(0, 5, (6, d)).astype(float)
    ensemble = T.Ensemble(T.flatten(trees, weights), stump, *limits)
    got, again = ensemble.contributions(x, d), ensemble.contributions(x[::-1], d)[::-1]
    for row, phi in zip(x, got):
        want, base = brute(trees, weights, row)
        assert np.allclose(phi, want, atol=1e-9) and ensemble.base() == pytest.approx(base, abs=1e-9)
    assert np.array_equal(got, again)


def test_many_features_on_a_deep_path():
    """Over 16 distinct features on a path: numbers need more than 16 bits, and no table is made."""
    rng, d = np.random.default_rng(5), 24
    tree, count = {}, 1 << 25
    for i in range(d):
        tree[2 * i] = {"prediction": 0.0, "rawCount": count, "leftChild": 2 * i + 1, "rightChild": 2 * i + 2, "featureIndex": i, "leftCategoriesOrThreshold": [0.5], "numCategories": -1}
        tree[2 * i + 1] = {"prediction": float(i + 1), "rawCount": count // 2, "leftChild": -1, "rightChild": -1, "featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}
        count //= 2
    tree[2 * d] = {"prediction": 99.0, "rawCount": count, "leftChild": -1, "rightChild": -1, "featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}
    ensemble = T.Ensemble(T.flatten([tree], [2.0]))
    x = rng.integers(0, 2, (50, d)).astype(float)
    x[0], x[1] = 1.0, 0.0
    out = np.array([2.0 * expected(tree, 0, row, set(range(d))) for row in x])
    assert np.allclose(ensemble.contributions(x, d).sum(1) + ensemble.base(), out, atol=1e-6)
    # what all but the last rows' features say is the same, so their contributions are too
    assert np.allclose(ensemble.contributions(np.vstack([x[0], x[0]]), d), ensemble.contributions(x[:1], d))


def test_rows_in_steps_and_splits_once(monkeypatch):
    rng = np.random.default_rng(1)
    trees = [grow(rng, 5, 3) for _ in range(10)]
    flat = T.flatten(trees, [1.0] * 10)
    keys = {(n["featureIndex"], tuple(n["leftCategoriesOrThreshold"])) for t in trees for n in t.values() if n["leftChild"] >= 0}
    assert len(flat["feature"]) == len(keys) and T.flat_bytes(flat) > 0
    x = rng.integers(0, 5, (500, 3)).astype(float)
    whole = T.Ensemble(flat).contributions(x, 3)
    monkeypatch.setattr(T, "MASK_BYTES", 7 * len(keys))
    assert np.array_equal(T.Ensemble(flat).contributions(x, 3), whole)
    assert T.Ensemble(flat).contributions(x[:0], 3).shape == (0, 3)
