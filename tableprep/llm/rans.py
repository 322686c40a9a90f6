"""Static range asymmetric numeral coding of token ids (numpy, many lanes at once).

Block layout, all little-endian::

    "RANB" version:u16 bits:u8 _:u8 lanes:u32 docs:u32 tokens:u64 segments:u32 stride:u32 words:u64 table_crc:u32
    id_is_null:u8[docs]  doc_id:i64[docs]  length:u64[docs]
    word_offset:u64[segments]  segment_crc:u32[segments]  state:u64[segments][lanes]
    word:u32[words]  crc:u32 (of everything before it)

Token i of a block belongs to lane ``i % lanes``; the lanes share one stream of 32-bit
words.  A checkpoint every ``stride`` steps keeps the lane states and the place in the
stream, so each segment decodes by itself; its crc32 covers its decoded ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sHBBIIQIIQI")
THIRTY_TWO = np.uint64(32)


def quantise(symbols: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 each; the largest counts absorb the rounding."""
    total, room = int(counts.sum()), 1 << bits
    if len(symbols) == 0:
        return np.zeros(0, np.int64)
    if len(symbols) > room:
        raise ValueError("more symbols than slots")
    freq = np.maximum(1, counts.astype(object) * room // total).astype(np.int64)
    order = np.lexsort((symbols, -counts))
    left = room - int(freq.sum())
    if left > 0:
        freq[order[0]] += left
    while left < 0:
        for i in order:
            cut = min(-left, max(0, int(freq[i]) // 2))
            freq[i] -= cut
            left += cut
            if not left:
                break
    return freq


class Table:
    """Shared frequencies of one corpus: symbol -> (frequency, start), slot -> symbol."""

    def __init__(self, symbols, freqs, bits: int):
        symbols, freqs = np.asarray(symbols, np.int64), np.asarray(freqs, np.int64)
        order = np.argsort(symbols)
        symbols, freqs = symbols[order], freqs[order]
        size = int(symbols[-1]) + 1 if len(symbols) else 1
        self.bits = bits
        self.freq = np.zeros(size, np.uint64)
        self.freq[symbols] = freqs
        self.start = np.zeros(size, np.uint64)
        self.start[symbols] = np.concatenate(([0], np.cumsum(freqs)[:-1])) if len(symbols) else 0
        self.slot = np.repeat(symbols, freqs).astype(np.uint32)
        self.crc = zlib.crc32(symbols.astype("<i8").tobytes() + freqs.astype("<i8").tobytes())


def lanes_for(tokens: int, most: int) -> int:
    """A power of two that leaves each lane at least 64 tokens, up to ``most``."""
    lanes = 1
    while lanes * 2 <= most and lanes * 128 <= tokens:
        lanes *= 2
    return lanes


def encode_block(table: Table, doc_ids: list, lengths: list, ids: np.ndarray, lanes: int = 1024, stride: int = 128) -> bytes:
    n = len(ids)
    lanes = lanes_for(n, lanes)
    steps = -(-n // lanes)
    segments = -(-steps // stride)
    bits, down = np.uint64(table.bits), np.uint64(31 + 32 - table.bits)
    mask32 = np.uint64(0xFFFFFFFF)
    freq, start = table.freq[ids], table.start[ids]
    x = np.full(lanes, LOW, np.uint64)
    out, states, sizes = [], np.empty((segments, lanes), np.uint64), np.zeros(steps + 1, np.int64)
    for t in range(steps - 1, -1, -1):
        f, s = freq[t * lanes: (t + 1) * lanes], start[t * lanes: (t + 1) * lanes]
        y = x[: len(f)]
        big = y >= (f << down)
        word = y[big]
        out.append((word & mask32).astype("<u4"))
        sizes[t] = len(word)
        y = np.where(big, y >> THIRTY_TWO, y)
        q = y // f
        x[: len(f)] = (q << bits) + (y - q * f) + s
        if t % stride == 0:
            states[t // stride] = x
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    ends = np.concatenate(([0], np.cumsum(sizes[:-1])))
    offsets = ends[np.arange(segments) * stride] if segments else np.zeros(0, np.int64)
    crcs = [zlib.crc32(ids[k * stride * lanes: (k + 1) * stride * lanes].astype("<u4").tobytes()) for k in range(segments)]
    body = b"".join((
        HEAD.pack(b"RANB", 1, table.bits, 0, lanes, len(doc_ids), n, segments, stride, len(words), table.crc),
        np.array([d is None for d in doc_ids], "u1").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u8").tobytes(),
        offsets.astype("<u8").tobytes(), np.array(crcs, "<u4").tobytes(), states.astype("<u8").tobytes(), words.tobytes(),
    ))
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A parsed block; ``segment(k)`` decodes one stretch between checkpoints."""

    def __init__(self, table: Table, data: bytes):
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("block checksum does not match")
        magic, version, bits, _, self.lanes, docs, self.tokens, self.segments, self.stride, words, crc = HEAD.unpack_from(data)
        if (magic, version, bits, crc) != (b"RANB", 1, table.bits, table.crc):
            raise ValueError("not a block of this frequency table")
        self.table, at = table, HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        null, ids = take("u1", docs), take("<i8", docs)
        self.doc_ids = [None if z else int(i) for z, i in zip(null, ids)]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.offsets, self.crcs = take("<u8", self.segments), take("<u4", self.segments)
        self.states = take("<u8", self.segments * self.lanes).reshape(self.segments, self.lanes)
        self.words = take("<u4", words)

    def segment(self, k: int) -> np.ndarray:
        first = k * self.stride * self.lanes
        out = np.empty(min(self.tokens - first, self.stride * self.lanes), "<u4")
        x, at, table = self.states[k].copy(), int(self.offsets[k]), self.table
        bits, low = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
        for i in range(0, len(out), self.lanes):
            y = x[: min(self.lanes, len(out) - i)]
            slot = y & low
            got = table.slot[slot]
            out[i: i + len(y)] = got
            y = table.freq[got] * (y >> bits) + slot - table.start[got]
            need = np.flatnonzero(y < LOW)
            y[need] = (y[need] << THIRTY_TWO) | self.words[at: at + len(need)]
            at += len(need)
            x[: len(y)] = y
        if zlib.crc32(out.tobytes()) != self.crcs[k]:
            raise ValueError("segment checksum does not match")
        return out

    def ids(self) -> np.ndarray:
        return np.concatenate([self.segment(k) for k in range(self.segments)]) if self.segments else np.zeros(0, "<u4")
