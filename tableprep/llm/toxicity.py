"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: the hashes of its words (ASCII-lower-cased runs of letters and
digits), of their stems (first four to eight bytes, so that inflected forms of a word
share slots), of word pairs and of pairs with one word between, each once, in ``2**BITS``
slots, plus a bias.  FTRL-proximal keeps per-coordinate rates and an L1 penalty that leaves most
weights at exactly zero; only the others are broadcast (at most ``2**BITS``, a few
thousand in practice).

Training rows: at most ``max_rows`` labelled documents that are not held out, those of the
least md5 of their id, then of the least text hash; equal rows count once.  Spark hashes
their texts; the learner, which is sequential by nature, reads that bounded table in one task.  Scoring hashes every document in one pass
without a shuffle.

NULL text counts as empty: its score is the bias alone.  A NULL doc_id is not held out and
meets no label; repeated documents are scored each; NULL labels don't train; with no
usable label the score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm import _common as C
from tableprep.llm.quality import held_out, training_labels, training_texts

BITS, MAX_ROWS, EPOCHS, THRESHOLD = 20, 12_000, 4, 0.7
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.1
STEMS = (4, 5, 6, 7, 8)
BIAS = 1 << BITS  # the slot after the hashed ones
SLICE = 256 << 10  # bytes of text hashed at once, in about 70 times their size

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """A 64-bit code for each byte of a word, 0 for what separates words; capitals share their small letters' codes."""
    b = np.arange(256, dtype=np.uint64)
    low = np.where((b >= 65) & (b <= 90), b + np.uint64(32), b)
    word = ((low >= 97) & (low <= 122)) | ((b >= 48) & (b <= 57)) | (b >= 128)
    return np.where(word, mix(low + np.uint64(1)) | np.uint64(1), np.uint64(0))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LETTERS = _letters()


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hash and text number of every word, and the hashes of its stems (0 where the word is no longer than the stem)."""
    code = LETTERS[data]
    inside = code != 0
    starts = inside & ~np.concatenate(([False], inside[:-1]))
    first = off[:-1][off[:-1] < len(data)]
    starts[first] = inside[first]  # a word doesn't go on from one text to the next
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in STEMS]
    places = np.flatnonzero(inside)
    word = np.cumsum(starts)[places] - 1
    place = places - at[word]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(place.max()), _ODD, np.uint64))))
        cuts = np.searchsorted(places, at)
        term = code[places] * power[place]
        total = np.add.reduceat(term, cuts)
        size = np.diff(np.append(cuts, len(places)))
        stems = []
        for k in STEMS:
            # the sum of the first k terms of each word that is longer
            long = size > k
            head = term[cuts[long][:, None] + np.arange(k)].sum(1, dtype=np.uint64)
            stem = np.zeros(len(at), np.uint64)
            stem[long] = mix(head + np.uint64(k))
            stems.append(stem)
    return mix(total), np.searchsorted(off, at, "right") - 1, stems


def slots(hashes: np.ndarray, text: np.ndarray, stems: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text number of every word, stem, pair, and pair with a word between."""
    down = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        pair = mix(hashes[:-1] * np.uint64(3) + mix(hashes[1:]) + np.uint64(1))
        skip = mix(hashes[:-2] * np.uint64(5) + mix(hashes[2:]) + np.uint64(2))
    near, far = text[:-1] == text[1:], text[:-2] == text[2:]
    return (np.concatenate([hashes >> down, pair[near] >> down, skip[far] >> down, *(s[s != 0] >> down for s in stems)]).astype(np.int64),
            np.concatenate([text, text[:-1][near], text[:-2][far], *(text[s != 0] for s in stems)]))


def feature_slices(column: pa.Array):
    """Distinct slots of each text, in slices of the column: the first text, where each text's slots begin (and the last one's end), the slots."""
    data, off = C.utf8_batch(column)
    for i, j in C.slices(off, SLICE):
        slot, text = slots(*word_hashes(data[off[i]: off[j]], off[i: j + 1] - off[i]))
        key = np.unique(text << (BITS + 1) | slot)
        yield i, np.searchsorted(key >> (BITS + 1), np.arange(j - i + 1)), (key & (BIAS - 1)).astype("<u4")


def features(column: pa.Array) -> list[np.ndarray]:
    """Distinct slots of each text."""
    return [row for _, cut, slot in feature_slices(column) for row in np.split(slot, cut[1:-1])]


def learn(rows: Sequence[tuple[np.ndarray, float]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over the rows in turn; the slots with a weight, and their weights."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(i):
        # the bias bears no penalty
        lean = np.where(i == BIAS, 0.0, L1)
        return np.where(np.abs(z[i]) <= lean, 0.0, (np.sign(z[i]) * lean - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + np.where(i == BIAS, 0.0, L2)))

    for _ in range(epochs):
        for slot, y in rows:
            i = np.append(slot, BIAS)
            w = weights(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    every = np.arange(BIAS + 1)
    w = weights(every)
    return every[w != 0], w[w != 0]


class Rows(Sequence):
    """(slots, y) of the training rows in their turn, as views of the Arrow table that holds them."""

    def __init__(self, table: pa.Table):
        self.slots, self.y = table.column("slots"), table.column("y")
        self.order = pc.sort_indices(table, [(c, "ascending") for c in ("turn", "slots", "y")]).to_numpy()

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, k):
        at = int(self.order[k])
        return np.frombuffer(self.slots[at].as_buffer(), "<u4").astype(np.int64), self.y[at].as_py()


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    def hashed(batches):
        for batch in batches:
            # each slice goes out before the next is hashed
            for i, cut, slot in feature_slices(batch.column(3)):
                n = len(cut) - 1
                rows = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(slot)])
                yield pa.RecordBatch.from_arrays([*(c.slice(i, n) for c in batch.columns[:3]), rows], names=["turn", "h", "y", "slots"])

    def train(table: pa.Table) -> pa.Table:
        slot, w = learn(Rows(table))
        return pa.table({"slot": slot, "w": w})

    chosen = training_labels(labels, "toxic", max_rows, ~held_out("doc_id", 3, 1))
    # hashed first and written, so that the top-k takes short rows: an id's turn, not its text
    hashed_rows = C.materialize(training_texts(docs, chosen, 7).mapInArrow(hashed, "turn string, h long, y double, slots binary"), "toxic-slots")
    kept = hashed_rows.select("turn", "h", "y").distinct().orderBy("turn", "h", "y").limit(max_rows)
    once = hashed_rows.groupBy("turn", "h", "y").agg(F.any_value("slots").alias("slots"))
    # `kept` is bounded by max_rows, so it may be broadcast, and one task may learn from the rows it leaves
    table = once.join(F.broadcast(kept), ["turn", "h", "y"], "left_semi").select("turn", "y", "slots")
    got = table.groupBy().applyInArrow(train, "slot long, w double").collect()
    return np.array([r.slot for r in got], np.int64), np.array([r.w for r in got], float)


def score_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score of every document."""
    def run(batches):
        weight = np.zeros(BIAS + 1)
        weight[model[0]] = model[1]
        for batch in batches:
            data, off = C.utf8_batch(batch.column(1))
            total = np.full(len(off) - 1, weight[BIAS])
            for i, j in C.slices(off, SLICE):
                slot, text = slots(*word_hashes(data[off[i]: off[j]], off[i: j + 1] - off[i]))
                hit = weight[slot] != 0
                key = np.unique(text[hit] << (BITS + 1) | slot[hit])  # each slot once a text
                total[i:j] += np.bincount(key >> (BITS + 1), weight[key & (BIAS - 1)], j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    scored = score_documents(docs, fit(docs, labels, max_rows))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
