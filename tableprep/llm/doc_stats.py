"""Statistics of whole texts, from their UTF-8 bytes: counts of byte kinds for a batch at once, words and lines text by text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tableprep.llm import _common as C

SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_bytes", "n_upper", "n_lower", "n_digits", "n_marks", "n_high", "n_lines", "n_distinct_words", "n_blank_lines", "n_long_words",
        "n_pipes", "n_bangs", "n_caps_words", "n_stops"]


def _kinds() -> dict[str, np.ndarray]:
    b = np.arange(256)
    among = lambda chars: np.isin(b, list(chars))
    upper, lower, digit = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    return {
        "word_chars": ~C.SPACE & ((b & 0xC0) != 0x80), "n_symbols": among(SYMBOLS), "n_upper": upper, "n_lower": lower, "n_digits": digit,
        "n_marks": (b > 32) & (b < 127) & ~upper & ~lower & ~digit, "n_high": b >= 128, "n_pipes": among(b"|"), "n_bangs": among(b"!?"), "n_stops": among(b".,;:"),
    }


KINDS = _kinds()


def byte_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """How many bytes of each kind every text has: one histogram a text."""
    hist = np.zeros((len(off) - 1, 256), np.int64)
    for i, (a, b) in enumerate(zip(off[:-1], off[1:])):
        if b > a:
            hist[i] = np.bincount(data[a:b], minlength=256)
    return {k: hist @ m for k, m in KINDS.items()} | {"n_bytes": np.diff(off)}


def repeated_words(words: list[bytes], window: int = 3) -> tuple[int, int]:
    """Words inside windows that the text has twice or more, and the distinct words."""
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    if len(ids) < window:
        return 0, len(names)
    key = ids[: len(ids) - window + 1]
    for k in range(1, window):
        if k > 1 and len(names) ** 3 >= 1 << 63:  # names of the pairs so far keep the key within 63 bits
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(names) + ids[k: len(ids) - window + 1 + k]
    order = np.argsort(key, kind="stable")
    same = np.concatenate(([False], np.diff(key[order]) == 0))
    twice = np.zeros(len(key), bool)
    twice[order] = same | np.concatenate((same[1:], [False]))
    inside = np.zeros(len(ids), bool)
    for k in range(window):
        inside[k: k + len(twice)] |= twice
    return int(inside.sum()), len(names)


def line_counts(text: bytes) -> tuple[int, int, int]:
    """Lines, lines without a word, and lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    worded = [line for line in lines if not line.isspace() and line]
    return len(lines), len(lines) - len(worded), len(worded) - len(set(worded))


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All of BASE and MORE for a column of texts (NULL: empty)."""
    data, off = C.utf8_batch(column)
    out, rows = byte_counts(data, off), []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        text = data[a:b].tobytes()
        words = text.split()
        repeat, distinct = repeated_words(words)
        lines, blank, dup = line_counts(text)
        rows.append((len(words), dup, repeat, lines, distinct, blank, sum(map((20).__lt__, map(len, words))), sum(map(bytes.isupper, words))))
    cols = np.array(rows, np.int64).reshape(-1, 8).T
    return out | dict(zip(("n_words", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_blank_lines", "n_long_words", "n_caps_words"), cols))


FEATURES = ["log_bytes", "log_words", "word_length", "upper", "lower", "digits", "marks", "high", "symbols", "pipes", "bangs", "stops",
            "words_per_line", "dup_lines", "blank_lines", "repeat_words", "distinct_words", "long_words", "caps_words"]


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Scale-free ratios of the counts; an empty text is all zeros."""
    n_bytes, words, lines = (np.maximum(1, s[k]).astype(float) for k in ("n_bytes", "n_words", "n_lines"))
    some = (s["n_bytes"] > 0).astype(float)
    chars = np.maximum(1, s["word_chars"])
    return np.stack([
        np.log1p(s["n_bytes"]), np.log1p(s["n_words"]), s["word_chars"] / words, s["n_upper"] / n_bytes, s["n_lower"] / n_bytes, s["n_digits"] / n_bytes,
        s["n_marks"] / n_bytes, s["n_high"] / n_bytes, s["n_symbols"] / chars, s["n_pipes"] / words, s["n_bangs"] / words, s["n_stops"] / words,
        some * s["n_words"] / lines, s["n_dup_lines"] / lines, some * s["n_blank_lines"] / lines, s["n_repeat_words"] / words, s["n_distinct_words"] / words,
        s["n_long_words"] / words, s["n_caps_words"] / words], 1)
