import struct
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tableprep.llm import packing, rans, token_output, tokens

from ..conftest import SF001

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@cache
def tokenizer(path):
    return Tokenizer.from_file(path)


def ids_of(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from(list(" \n\tab'ésZ.,!19<|>́\x1c\xa0 ßİ")), st.characters(codec="utf-8")), max_size=30), max_size=6))
def test_memo_equals_the_library(path, texts):
    tok = tokenizer(path)
    got = [np.frombuffer(b, "<u4").tolist() for b in tokens.encoder(path).encode(texts)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_piece_table_forgets_compares_bytes_and_cuts_long_texts(monkeypatch):
    tok, rng = tokenizer(BYTE), np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeé ,.")) for _ in range(rng.integers(1, 40))).replace(" ", "") or "x" for _ in range(4000)]
    texts = [" ".join(rng.choice(words, 300)).replace("e", "\n", 2).strip() for _ in range(40)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    enc = tokens.Encoder(BYTE, 500)  # forgets again and again
    for _ in range(3):
        for t, ids in zip(texts, want):
            assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == ids
    assert enc.table.used <= 500 + 4000
    monkeypatch.setattr(tokens, "LONG", 50)
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.Encoder(BYTE, 500).encode(texts)] == want
    # slots that lead to other pieces' entries are passed over
    enc = tokens.Encoder(BYTE, 300)
    enc.table.bits, enc.table.slots = 13, np.full(1 << 13, -1, np.int32)
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == want
    assert (enc.table.slots >= 0).sum() == enc.table.used


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 70_000])
def test_rans_block_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 5000).astype(np.int64)
    symbols, counts = np.unique(ids, return_counts=True)
    table = rans.Table(symbols, rans.quantise(symbols, counts, 16), 16)
    data = rans.encode_block(table, [3, None], [n // 2, n - n // 2], ids, lanes=64, stride=16)
    block = rans.Block(table, data)
    assert block.ids().tolist() == ids.tolist() and block.doc_ids == [3, None]
    for k in reversed(range(block.segments)):  # each segment by itself
        assert block.segment(k).tolist() == ids[k * 16 * block.lanes: (k + 1) * 16 * block.lanes].tolist()
    with pytest.raises(ValueError):
        rans.Block(table, data[:40] + bytes([data[40] ^ 1]) + data[41:])


def test_token_files_round_trip(spark, docs, odd_docs, tmp_path):
    for name, df in (("a", docs), ("b", odd_docs)):
        token_output.write_tokens(df, f"{tmp_path}/{name}", BYTE, block_tokens=5000)
        got = {}
        for r in token_output.read_tokens(spark, f"{tmp_path}/{name}", with_ids=True).collect():
            got.setdefault(r.doc_id, []).append(np.frombuffer(r.ids, "<u4").tolist())
        want = {}
        for r in df.collect():
            want.setdefault(r.doc_id, []).append(ids_of(BYTE, r.text))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
        rows = sorted(token_output.digest(spark, f"{tmp_path}/{name}").collect(), key=lambda r: (r.start, r.n_tokens))
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))
        assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()


@pytest.mark.parametrize("first, last", [(0, 10 ** 9), (0, 1), (4990, 5020), (12_345, 31_000), (7, 7), (10 ** 8, 10 ** 9)])
def test_a_range_of_ids_decodes_only_its_segments(spark, docs, tmp_path, first, last):
    path = f"{tmp_path}/r"
    token_output.write_tokens(docs, path, BYTE, block_tokens=5000)
    every = [i for r in sorted(docs.collect(), key=lambda r: r.doc_id) for i in ids_of(BYTE, r.text)]
    got = sorted(token_output.read_range(spark, path, first, last).collect())
    assert [i for r in got for i in np.frombuffer(r.ids, "<u4").tolist()] == every[first:last]
    assert [r.start for r in got] == np.cumsum([first, *(len(r.ids) // 4 for r in got)])[:-1].tolist()


def test_block_range_counts_segments(monkeypatch):
    ids = np.arange(50_000) % 300
    table = rans.Table(np.arange(300), rans.quantise(np.arange(300), np.bincount(ids), 16), 16)
    block, decoded = rans.Block(table, rans.encode_block(table, [1], [50_000], ids, lanes=64, stride=16)), []
    segment = rans.Block.segment
    monkeypatch.setattr(rans.Block, "segment", lambda self, k: decoded.append(k) or segment(self, k))
    assert token_output.block_range(block, 2000, 3100).tolist() == ids[2000:3100].tolist()
    assert decoded == [1, 2, 3]  # of 49, each of 16 steps of 64 lanes


def test_a_row_that_a_third_repeat_is_dealt_over_ranges(spark, docs, tmp_path):
    one = docs.limit(1).selectExpr("5L AS doc_id", "text").crossJoin(spark.range(4000).select())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few rows would else be put together again
    try:
        token_output.write_tokens(one.unionByName(docs.select("doc_id", "text")), f"{tmp_path}/hot", BYTE, block_tokens=5000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(f"{tmp_path}/hot/blocks").groupBy("part").sum("n_docs").collect()
    assert len(parts) > 4 and max(r[1] for r in parts) < 0.5 * 5000


def test_token_files_of_no_documents(spark, no_docs, tmp_path):
    token_output.write_tokens(no_docs, f"{tmp_path}/e", BYTE)
    assert token_output.digest(spark, f"{tmp_path}/e").collect() == []


def test_op2_matches_direct_encoding(spark, docs):
    got = {r.doc_id: r for r in token_output.op2_rans_tokens(spark, SF001).collect()}
    start, tok = 0, tokenizer(BYTE)
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def check_packing(rows, want, capacity):
    """``want``: the (doc_id, ids) of every document; pieces, lengths and gapless sequences must fit."""
    bins, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    expected = defaultdict(list)
    for doc_id, ids in want:
        expected[doc_id] += [(k, b, len(ids[b: b + capacity]), crc(ids[b: b + capacity])) for k, b in enumerate(range(0, len(ids), capacity))]
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in expected.items()}
    return len(bins)


def test_op5_packs_every_piece(spark, docs):
    tok = tokenizer(WORD)
    want = [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in docs.collect()]
    used = check_packing(packing.op5_best_fit_packing(spark, SF001).collect(), want, 2048)
    assert used <= 1.01 * sum(len(i) for _, i in want) / 2048 + 1


def test_packing_of_odd_rows(odd_docs, no_docs):
    want = [(r.doc_id, ids_of(WORD, r.text)) for r in odd_docs.collect()]
    check_packing(packing.pack_documents(odd_docs, WORD, capacity=64).collect(), want, 64)
    assert packing.pack_documents(no_docs, WORD).collect() == []


def test_pieces_carry_their_ids(odd_docs):
    rows = packing.pack_documents(odd_docs, WORD, capacity=50, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)


def optimum(sizes, capacity):
    """Fewest bins by exhaustive search."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1:])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_an_optimum(sizes):
    """The sets fixed by dominance plus an optimal packing of the rest are as few as the optimum."""
    counts = {s: sizes.count(s) for s in set(sizes)}
    left = packing.Sizes(counts)
    fixed = sum(n for n, _ in packing.reduce_dominated(left, 20))
    rest = [s for s, n in left.count.items() for _ in range(n)]
    assert fixed + optimum(sorted(rest, reverse=True), 20) == optimum(sorted(sizes, reverse=True), 20)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 400), max_size=12))
def test_plan_places_every_rank_once(counts):
    used, fill = defaultdict(int), defaultdict(list)
    for s, lo, hi, each, first, at in sorted(packing.plan(counts, 30)):
        assert lo == used[s]
        used[s] = hi
        for r in range(hi - lo):
            fill[first + r // each].append((at + r % each * s, s))
    assert dict(used) == counts
    for parts in fill.values():
        end = 0
        for at, s in sorted(parts):
            assert at == end
            end += s
        assert end <= 30
