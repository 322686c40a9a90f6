"""Token ids through the ``tokenizers`` library, with a per-worker memo of words.

A text whose white space is single spaces and newlines falls into pieces that no
pre-token crosses (a word with the space before it, or a newline), so each distinct
piece goes through the library's normaliser, pre-tokeniser and model once per worker
and is looked up afterwards.  Any other text (runs of white space, tabs, special-token
strings, unknown tokenizer layouts) is encoded whole.  Both ways give the ids of
``encode(text, add_special_tokens=False)``.

With a byte-level tokenizer the look-up is vectorised (``PieceTable``): a group of texts is
one byte buffer, its pieces are keyed by their bytes, and numpy gathers all their ids.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from array import array

import numpy as np

LONG = 2 << 20  # characters of a text that are looked up at once
MEMO_WORDS = 400_000  # entries a worker keeps (about 200 bytes each) before it drops the newer half

# fixed values: white space but space and newline, and NUL (the mark that texts are split at)
_ODD = "\0\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = ("  ", " \n", "\n ", "\n\n")
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_loaded: dict[str, "Encoder"] = {}


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in printable else next(rest)) for b in range(256)}


class Memo(dict):
    """Pieces and their ids; a piece not met yet is encoded."""

    def __init__(self, encode, known=()):
        super().__init__(known)
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.encode(piece)
        return ids


def long_parts(text: str):
    """A long text cut in front of spaces, between its pieces."""
    at = 0
    while at >= 0:
        end = text.find(" ", at + LONG)
        yield text[at:] if end < 0 else text[at:end]
        at = end


class PieceTable:
    """Ids of pieces of at most ``WIDTH`` bytes, looked up for a whole buffer at once.

    A piece is known by its bytes, packed into three 64-bit words (no text here holds a NUL,
    so the padding is unambiguous).  Its place is found by a hash of the words, by linear
    probing of all pieces together; the words themselves are always compared."""

    WIDTH = 24
    KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most
        self.bits = max(10, (4 * most - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.words, self.home = np.zeros((1 << 16, 3), np.uint64), np.zeros(1 << 16, np.int64)
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, "<u4")
        self.used = self.used_ids = 0

    def _put(self, at: int, raw: list[bytes], ids_at: int) -> int:
        """Write entries from ``at`` on and their ids from ``ids_at`` on; returns where the next ids go."""
        got = np.frombuffer(b"".join(raw), "<u4")
        while at + len(raw) > len(self.start):
            self.words, self.home, self.start, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.words, self.home, self.start, self.size))
        while ids_at + len(got) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        n = np.array([len(r) // 4 for r in raw], np.int64)
        self.start[at: at + len(raw)], self.size[at: at + len(raw)] = ids_at + np.cumsum(n) - n, n
        self.ids[ids_at: ids_at + len(got)] = got
        return ids_at + len(got)

    def _forget(self) -> None:
        """Keep the entries met first: those are the frequent ones."""
        self.used = self.most // 2
        self.used_ids = int(self.start[self.used])
        self.slots[:] = -1
        self._place(np.arange(self.used))

    def _place(self, entry: np.ndarray) -> None:
        """Put entries into the first free slot from their home on."""
        at = self.home[entry]
        while len(entry):
            free = self.slots[at] < 0
            self.slots[at[free]] = entry[free]
            left = self.slots[at] != entry
            entry, at = entry[left], (at[left] + 1) & (len(self.slots) - 1)

    def _find(self, words: np.ndarray, home: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 where there is none."""
        found, left, at = np.full(len(home), -1, np.int64), np.arange(len(home)), home
        while len(left):
            entry = self.slots[at]
            some = entry >= 0
            left, at, entry = left[some], at[some], entry[some]
            got, want = self.words[entry], words[left]
            same = (got[:, 0] == want[:, 0]) & (got[:, 1] == want[:, 1]) & (got[:, 2] == want[:, 2])
            found[left[same]] = entry[same]
            left, at = left[~same], (at[~same] + 1) & (len(self.slots) - 1)
        return found

    def look_up(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids) of the pieces of a buffer."""
        if self.used > self.most:
            self._forget()
        padded = np.frombuffer(data + bytes(2 * self.WIDTH), np.uint8)
        eights = np.ndarray((len(data) + self.WIDTH,), "<u8", padded, 0, (1,))  # the 8 bytes from every place on
        words = np.stack([eights[starts + 8 * k] & self.KEEP[np.clip(sizes - 8 * k, 0, 8)] for k in range(3)], 1)
        with np.errstate(over="ignore"):
            key = words[:, 2] * np.uint64(0x9E3779B97F4A7C15)
            for k in (1, 0):
                key = (key ^ (key >> np.uint64(29)) ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(32)
        home = (key & np.uint64(len(self.slots) - 1)).astype(np.int64)
        found = self._find(words, home)
        long = sizes > self.WIDTH
        found[long] = -1
        miss = np.flatnonzero((found < 0) & ~long)
        encode, ids_at = self.encode, self.used_ids
        if len(miss):
            _, first = np.unique(key[miss], return_index=True)
            new = miss[first]
            ids_at = self._put(self.used, [encode(data[a: a + n].decode()) for a, n in zip(starts[new].tolist(), sizes[new].tolist())], ids_at)
            entry = self.used + np.arange(len(new))
            self.words[entry], self.home[entry] = words[new], home[new]
            self._place(entry)
            self.used, self.used_ids = self.used + len(new), ids_at
            found[miss] = self._find(words[miss], home[miss])
        # long ones (and those that share all 64 bits of another new one's hash) are encoded here and not kept
        alien = np.flatnonzero(found < 0)
        if len(alien):
            self._put(self.used, [encode(data[a: a + n].decode()) for a, n in zip(starts[alien].tolist(), sizes[alien].tolist())], ids_at)
            found[alien] = self.used + np.arange(len(alien))
        n = self.size[found]
        total = np.cumsum(n)
        return n, self.ids[np.repeat(self.start[found] - total + n, n) + np.arange(total[-1] if len(total) else 0)]


class Encoder:
    def __init__(self, path: str, memo_words: int):
        self.memo_words = memo_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.norm, self.pre = self.tok.model, self.tok.normalizer, self.tok.pre_tokenizer
        spec = json.loads(self.tok.to_str())
        pre, self.memo, self.letters = spec["pre_tokenizer"] or {}, Memo(self._encode), byte_letters()
        steps = pre.get("pretokenizers", [])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.mode = "whole"
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not self.norm:
            self.mode = "spaced"
        elif ([s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
              and "\\s" in str(steps[0]["pattern"]) and [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]):
            self.mode = "words"
        self.vocab = self.tok.get_vocab_size()
        self.table = PieceTable(self._encode, memo_words)

    def _splits(self, text: str) -> bool:
        """Whether a text falls into pieces; else it has to be encoded whole."""
        if self.mode == "whole" or any(s in text for s in self.special):
            return False
        return self.mode == "words" or not (not text or text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, _RUNS)) or any(map(text.__contains__, _ODD)))

    def _spaced(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that split, by the table: a piece starts at every space and newline, and after a newline."""
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(r) for r in raw])
        data = b"".join(raw)
        b = np.frombuffer(data, np.uint8)
        begins = (b == 32) | (b == 10)
        begins[1:] |= b[:-1] == 10
        begins[0] = True
        begins[ends[:-1]] = True
        starts = np.flatnonzero(begins)
        n, ids = self.table.look_up(data, starts, np.diff(np.append(starts, len(data))))
        cuts = np.append(0, np.cumsum(n))[np.searchsorted(starts, np.append(0, ends))]
        out = ids.tobytes()
        return [out[4 * a: 4 * z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _part(self, word: str) -> bytes:
        """Ids of one plain pre-token, by the memo."""
        if len(self.memo) > 2 * MEMO_WORDS:
            self.memo.clear()
        got = self.memo.get(word)
        if got is None:
            unit = word.replace(" ", self.letters[32]) if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            got = self.memo[word] = array("I", [t.id for t in self.model.tokenize(unit)]).tobytes()
        return got

    def _encode(self, piece: str) -> bytes:
        plain = _PLAIN.fullmatch(piece)
        if plain:
            word, marks = plain.groups()
            if self.mode == "words":
                word = word.lstrip(" ").lower()
            return self._part(word) + self._part(marks) if marks else self._part(word)
        text = self.norm.normalize_str(piece) if self.norm else piece
        return array("I", [t.id for u, _ in self.pre.pre_tokenize_str(text) for t in self.model.tokenize(u)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.mode == "spaced":
            splits = [self._splits(t) for t in texts]
            plain = [t for t, s in zip(texts, splits) if s and len(t) <= LONG]
            got = iter(self._spaced(plain) if plain else ())
            return [self._whole(t) if not s else next(got) if len(t) <= LONG else b"".join(self._spaced([p])[0] for p in long_parts(t)) for t, s in zip(texts, splits)]
        if len(self.memo) > self.memo_words:  # the words met first are the frequent ones: keep those
            self.memo = Memo(self._encode, itertools.islice(self.memo.items(), self.memo_words // 2))
        get = self.memo.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) if self._splits(t) else self._whole(t) for t in texts]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()


def encoder(path: str, memo_words: int = MEMO_WORDS) -> Encoder:
    """The worker's encoder of a tokenizer file; ``memo_words`` bounds its memo."""
    if path not in _loaded:
        _loaded[path] = Encoder(path, memo_words)
    return _loaded[path]


def vocab_size(path: str) -> int:
    return encoder(path).vocab


def text_groups(texts: list, budget: int = 1 << 20):
    """Runs of texts of about ``budget`` characters, NULL read as empty."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= budget:
            yield run
            run, size = [], 0
    if run:
        yield run
