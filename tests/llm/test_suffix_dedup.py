import hashlib
from collections import Counter

import numpy as np
import pytest

from tableprep.llm import suffix_dedup

from ..conftest import SF001
from .conftest import DOCS


def brute(texts, length):
    """Per text: removed bytes, stretches, sha256 of the rest."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i: i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i: i + length]] > 1:
                gone[i: i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(df, length):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df, length).collect())
    rows = df.collect()
    assert got == sorted((str(r.doc_id), *b) for r, b in zip(rows, brute([r.text for r in rows], length)))
    return got


def test_whole_table_against_brute_force(spark, docs):
    got = {r.doc_id: r for r in suffix_dedup.op4_suffix_dedup(spark, SF001).collect()}
    rows = docs.collect()
    for r, want in zip(rows, brute([r.text for r in rows], 400)):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == want
    assert sum(g.n_removed for g in got.values())


@pytest.mark.parametrize("seed", range(6))
def test_random_edits(spark, seed):
    """Copies with small edits, periodic text, repeats inside one document; short windows."""
    rng = np.random.default_rng(seed)
    alphabet = "ab" if seed % 2 else "abcdefgh é\n"
    make = lambda n: "".join(rng.choice(list(alphabet), n))
    passage, texts = make(90), []
    for k in range(14):
        t = make(int(rng.integers(0, 200)))
        if k % 3 == 0:
            t += passage
        if k % 4 == 1:
            t = t + make(20) + t
        if k % 5 == 2 and texts:
            t = texts[-1][: int(rng.integers(1, 90))] + "#" + texts[-1][1:]
        texts.append(t)
    texts += [texts[0], "a" * 150, "ab" * 100, "", None]
    check(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS), 40)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, 32)
    assert suffix_dedup.dedup(no_docs).collect() == []


def test_kept_text(spark):
    df = spark.createDataFrame([(1, "xx" + "abcdefgh" * 3 + "yy", None, None, None), (2, "abcdefgh" * 3, None, None, None)], DOCS)
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(df, 16, with_text=True).collect()} == {1: b"xxyy", 2: b""}


@pytest.mark.parametrize("seed, length", [(0, 40), (1, 16), (2, 5)])
def test_plain_prefix_doubling_finds_the_same(spark, odd_docs, seed, length):
    """8, 16, 32 bytes and then the length itself, over every position."""
    rng = np.random.default_rng(seed)
    make = lambda n: "".join(rng.choice(list("abcé "), n))
    passage = make(60)
    texts = [make(int(rng.integers(0, 120))) + (passage if k % 3 else "") + make(30) for k in range(12)]
    texts += [texts[0], texts[1] + texts[1][:50], "a" * 90, "", None]
    df = spark.createDataFrame([(i, x, None, None, None) for i, x in enumerate(texts)], DOCS)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df, length, doubling=True).collect())
    assert got == [(i, *b) for i, b in enumerate(brute(texts, length))]
