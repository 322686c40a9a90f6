"""Exact path-dependent Shapley values of tree ensembles, by descents of flat trees.

A leaf's output, given a feature subset S, is a product game over the distinct features on
its path: a feature in S contributes 1 if the row meets all of the path's conditions on it
(else 0), one outside S the share of training cover that the path keeps at its splits.
Writing the coalition weights as integrals over [0, 1] turns feature i's Shapley value into

    value * (met_i - share_i) * integral of prod_{f != i} (met_f t + share_f (1 - t)) dt,

a polynomial of degree d - 1, which Gauss-Legendre nodes integrate exactly.

Rows are worked batch by batch.  Each distinct split of the ensemble is evaluated once per
batch, and every tree uses the same masks.  A tree is walked once: a node hands its
children, per row, a bit for every feature met so far.  The walk ends at *stumps*, nodes of
at most ``STUMP`` levels above their leaves: the bits of the path and the outcomes of the
splits inside are one number, and the summed contributions of all the stump's leaves are
looked up by it.  A stump's table over all its numbers is made once per worker; where it
would be wide, or the tables would pass ``TABLE_BYTES``, the numbers that occur in the
batch are solved instead, so no depth is refused.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from pyspark import cloudpickle

# Python workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STUMP = 2  # levels of splits in a stump
TABLE_BITS = 12  # wider numbers are not tabulated
TABLE_BYTES = 256 << 20  # tables a worker keeps
MASK_BYTES = 64 << 20  # masks of all splits for the rows worked at once


def flatten(trees: list[dict], weights: list[float]) -> dict:
    """An ensemble as flat arrays: nodes of all trees, and the distinct splits they use.

    ``trees`` maps node ids to rows of Spark's saved node table; node 0 is a tree's root.
    """
    nodes, roots, splits = [], [], {}
    for tree, weight in zip(trees, weights):
        first, place = len(nodes), {i: len(nodes) + k for k, i in enumerate(sorted(tree))}
        roots.append(first)
        for i in sorted(tree):
            n = tree[i]
            if n["leftChild"] < 0:
                nodes.append((-1, -1, -1, weight * n["prediction"], n["rawCount"]))
                continue
            categorical = n["numCategories"] >= 0
            key = (n["featureIndex"], categorical, tuple(n["leftCategoriesOrThreshold"]))
            nodes.append((splits.setdefault(key, len(splits)), place[n["leftChild"]], place[n["rightChild"]], 0.0, n["rawCount"]))
    split, left, right, value, cover = (np.array(c) for c in zip(*nodes)) if nodes else (np.zeros(0),) * 5
    args = [k[2] for k in splits]
    return {"split": split.astype(np.int32), "left": left.astype(np.int32), "right": right.astype(np.int32), "value": value.astype(float), "cover": cover.astype(float),
            "roots": np.array(roots, np.int32), "feature": np.array([k[0] for k in splits], np.int32), "categorical": np.array([k[1] for k in splits], bool),
            "arg": np.array([x for a in args for x in a], float), "arg_end": np.cumsum([len(a) for a in args]).astype(np.int64)}


def flat_bytes(flat: dict) -> int:
    return sum(a.nbytes for a in flat.values())


@lru_cache(maxsize=None)
def _nodes(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights on [0, 1] that are exact up to degree d - 1."""
    t, w = np.polynomial.legendre.leggauss((d + 1) // 2)
    return (t + 1) / 2, w / 2


def _product_game(met: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of product games: one row per feature, one column per pattern of ``met``."""
    d = len(share)
    t, w = _nodes(d)
    part = met[:, None, :] * t[None, :, None] + (share[:, None] * (1 - t)[None, :])[:, :, None]
    before, after = np.ones_like(part), np.ones_like(part)
    for f in range(1, d):
        before[f] = before[f - 1] * part[f - 1]
        after[d - 1 - f] = after[d - f] * part[d - f]
    return (met - share[:, None]) * np.einsum("q,dqn->dn", w, before * after)


class Stump:
    """The leaves below one node, as contributions per number."""

    def __init__(self, leaves: list, bits: dict[int, int], splits: list[int]):
        # leaves: (value, {feature: share}, {feature: [(place of the split, outcome wanted)]})
        self.leaves, self.bits, self.splits = leaves, bits, splits
        self.columns = sorted({f for _, shares, _ in leaves for f in shares})
        self.width = len(bits) + len(splits)

    def solve(self, numbers: np.ndarray) -> np.ndarray:
        """Contributions (one row per column) for the given numbers."""
        out, u = np.zeros((len(self.columns), len(numbers))), len(self.bits)
        for value, shares, wants in self.leaves:
            features = sorted(shares)
            if not features:
                continue
            met = np.ones((len(features), len(numbers)))
            for k, f in enumerate(features):
                if f in self.bits:
                    met[k] *= (numbers >> self.bits[f]) & 1
                for place, want in wants.get(f, ()):
                    met[k] *= ((numbers >> (u + place)) & 1) == want
            out[[self.columns.index(f) for f in features]] += value * _product_game(met, np.array([shares[f] for f in features]))
        return out


class Ensemble:
    """Descents of one flat ensemble for batches of rows."""

    def __init__(self, flat: dict, stump: int = STUMP, table_bits: int = TABLE_BITS, table_bytes: int = TABLE_BYTES):
        self.flat, self.stump, self.table_bits, self.room = flat, stump, table_bits, table_bytes
        self.stumps: dict[int, Stump] = {}
        self.tables: dict[int, np.ndarray] = {}
        self.height = np.zeros(len(flat["split"]), np.int32)
        for i in range(len(self.height) - 1, -1, -1):  # children stand behind their parents
            if flat["left"][i] >= 0:
                self.height[i] = 1 + max(self.height[flat["left"][i]], self.height[flat["right"][i]])
        self.left, self.right, self.split = flat["left"].tolist(), flat["right"].tolist(), flat["split"].tolist()
        self.feature = flat["feature"].tolist()

    def _share(self, node: int, child: int) -> float:
        return self.flat["cover"][child] / max(self.flat["cover"][node], 1)

    def base(self) -> float:
        """The mean output by training cover."""
        reach = np.zeros(len(self.split))
        reach[self.flat["roots"]] = 1.0
        for i in range(len(reach)):
            if self.left[i] >= 0:
                for c in (self.left[i], self.right[i]):
                    reach[c] = reach[i] * self._share(i, c)
        return float((reach * self.flat["value"]).sum())

    def masks(self, x: np.ndarray) -> np.ndarray:
        """For each distinct split, which rows go left (one byte a row)."""
        flat, start, out = self.flat, 0, np.zeros((len(self.feature), len(x)), np.uint8)
        for s, end in enumerate(flat["arg_end"].tolist()):
            column, arg = x[:, self.feature[s]], flat["arg"][start:end]
            out[s] = np.isin(column, arg) if flat["categorical"][s] else column <= arg[0]
            start = end
        return out

    def _below(self, node: int, bits: dict[int, int], shares: dict[int, float]) -> Stump:
        leaves, splits = [], []

        def walk(i: int, shares: dict, wants: dict) -> None:
            if self.left[i] < 0:
                leaves.append((self.flat["value"][i], shares, wants))
                return
            place, f = len(splits), self.feature[self.split[i]]
            splits.append(self.split[i])
            for child, want in ((self.left[i], 1), (self.right[i], 0)):
                walk(child, shares | {f: shares.get(f, 1.0) * self._share(i, child)}, wants | {f: wants.get(f, []) + [(place, want)]})

        walk(node, shares, {})
        return Stump(leaves, bits, splits)

    def contributions(self, x: np.ndarray, n_features: int) -> np.ndarray:
        """One row per row of ``x``, one column per feature."""
        step = max(1, MASK_BYTES // max(1, len(self.feature)))
        return np.concatenate([self._some(x[i: i + step], n_features) for i in range(0, len(x), step)] or [np.zeros((0, n_features))])

    def _some(self, x: np.ndarray, n_features: int) -> np.ndarray:
        out, masks = np.zeros((n_features, len(x))), self.masks(x)

        def look_up(node: int, number: np.ndarray, bits: dict, shares: dict) -> None:
            stump = self.stumps.get(node)
            if stump is None:
                stump = self.stumps[node] = self._below(node, bits, shares)
            if stump.width > 15 and number.dtype == np.uint16:
                number = number.astype(np.int64)
            for place, s in enumerate(stump.splits):
                number = number | (masks[s].astype(number.dtype) << (len(bits) + place))
            table = self.tables.get(node)
            size = 8 * len(stump.columns) << stump.width
            if table is None and stump.width <= self.table_bits and size <= self.room:
                table = self.tables[node] = stump.solve(np.arange(1 << stump.width))
                self.room -= size
            if table is None:
                seen, number = np.unique(number, return_inverse=True)
                table = stump.solve(seen)
            for f, row in zip(stump.columns, table):
                out[f] += row[number]

        def walk(node: int, number: np.ndarray, bits: dict, shares: dict) -> None:
            if self.height[node] <= self.stump:
                look_up(node, number, bits, shares)
                return
            f = self.feature[self.split[node]]
            if f not in bits and len(bits) == 15:
                number = number.astype(np.int64)
            met = masks[self.split[node]].astype(number.dtype)
            place = bits.get(f, len(bits))
            for child, here in ((self.left[node], met), (self.right[node], met ^ 1)):
                # a feature met before stays met only if this condition holds too
                next_number = number & ~((here ^ 1) << place) if f in bits else number | (here << place)
                walk(child, next_number, bits if f in bits else bits | {f: place}, shares | {f: shares.get(f, 1.0) * self._share(node, child)})

        for root in self.flat["roots"].tolist():
            walk(root, np.zeros(len(x), np.uint16), {}, {})
        return out.T


def attributor(flats: list[dict]) -> Callable[[np.ndarray, int], list[tuple[np.ndarray, float]]]:
    """Contributions and base value of every ensemble for batches of rows."""
    ensembles = [Ensemble(f) for f in flats]
    bases = [e.base() for e in ensembles]
    return lambda x, n: [(e.contributions(x, n), b) for e, b in zip(ensembles, bases)]
