"""Exact removal of repeated byte strings, by minimizer runs in place of prefix doubling.

Every byte covered by a ``length``-byte string that also starts anywhere else (same
document included) goes; strings are judged on the input and never cross documents.

Plain prefix doubling ranks every byte position in each of log2(length) sorts, which at
one row a byte is many times the corpus in shuffles.  Here the positions that Spark ranks
are sampled so that nothing is lost: each window of ``length`` bytes is led by the
position in it whose next ``length / 2`` bytes have the least hash (leftmost if equal).
Equal windows are led by equal strings at equal distance, and neighbouring windows share
their leader, so a run of windows is one row.  Ranks are names of strings (64-bit hashes,
always compared along with the names of the shorter strings inside); what is unique drops
out of each round:

1. length / 2: the leader's own string.  Unique: none of its windows is repeated.
2. the whole run (leader, all its windows).  Equal runs: all of their windows are repeated.
3. ``length - BLOCK + 1``: runs left over, cut into blocks of windows, by the string all
   windows of a block share.  Unique: none is repeated.
4. ``length``: single windows of the blocks left over, past the threshold.

Each round pairs the name from the round before with that of the longer string, sorts the
pairs by an aggregate with map-side combining, and writes its survivors to the shared
folder, so a lost executor costs a reread and a string that fills the corpus is counted
before it is shuffled.  Documents are known by (text hash, size): equal texts lose equal
bytes.

NULL text counts as empty; NULL doc_ids and repeated rows are kept each (repeated rows are
copies of one another); texts shorter than ``length`` keep everything; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm import _common as C
from tableprep.llm.toxicity import mix

LENGTH, BLOCK = 400, 16
SLICE = 1 << 20  # bytes of text worked on at once
FACTOR = 0xD6E8FEB86659FD93
CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOW = np.uint64(0xFFFFFFFF)

RUNS = "th long, n long, lo long, span int, shift int, gram long, whole long"
BLOCKS = "th long, n long, lo long, twice boolean, gram long, block int, inner long, first long, names array<long>"


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, f, np.uint64))), dtype=np.uint64) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))


class Names:
    """64-bit names of any stretches of a buffer, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        size = SLICE if len(data) <= SLICE else len(data)
        self.up, self.down = _powers(size)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(CODES[data] * self.up[: len(data)], dtype=np.uint64)))

    def of(self, a, b) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[b] - self.sums[a]) * self.down[a])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    n = len(values)
    rows = np.concatenate([values, np.full(-n % width + width, ~np.uint64(0), np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


def led_runs(data: np.ndarray, off: np.ndarray, length: int):
    """Runs of windows with one leader: document, first and last window, leader (places in the buffer), and the names."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, None
    names, half = Names(data), length // 2
    at = np.arange(len(data) - half + 1)
    least = sliding_least((names.of(at, at + half) & ~LOW) | at.astype(np.uint64), length - half + 1)
    leader, p = (least & LOW).astype(np.int64), np.arange(len(least))
    doc = np.searchsorted(off, p, "right") - 1
    whole = p + length <= off[doc + 1]
    p, doc, leader = p[whole], doc[whole], leader[whole]
    if not len(p):
        return none, none, none, none, names
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(leader) != 0) | (np.diff(doc) != 0))))
    last = np.concatenate((cut[1:], [len(p)])) - 1
    return doc[cut], p[cut], p[last], leader[cut], names


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def known_by(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"), F.octet_length(text).cast("long").alias("n"))


def find_runs(known: DataFrame, length: int) -> DataFrame:
    half = length // 2

    def run(batches):
        for batch in batches:
            data, off = C.utf8_batch(batch.column(2))
            th, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j in C.slices(off, SLICE):
                doc, lo, hi, leader, names = led_runs(data[off[i]: off[j]], off[i: j + 1] - off[i], length)
                if len(doc):
                    yield pa.RecordBatch.from_arrays(
                        [_long(th[i + doc]), _long(n[i + doc]), _long(lo - (off[i + doc] - off[i])), pa.array((hi - lo).astype(np.int32)), pa.array((leader - lo).astype(np.int32)),
                         _long(names.of(leader, leader + half)), _long(names.of(lo, hi + length))], names=["th", "n", "lo", "span", "shift", "gram", "whole"])

    return known.select("th", "n", "text").mapInArrow(run, RUNS)


def name_blocks(known: DataFrame, per_text: DataFrame, length: int, block: int) -> DataFrame:
    """Blocks of the windows of the wanted runs (gathered by text): the name of what a block's windows share, and of each window.
    Windows are numbered by their distance to the leader, so blocks of equal strings line up."""
    def run(batches):
        before = None
        for batch in batches:
            for th, n, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if before == (th, n):  # another copy of the text
                    continue
                before = (th, n)
                names = Names(np.frombuffer(text.as_buffer(), np.uint8))
                rows = []
                for r in runs:
                    leader, last = r["lo"] + r["shift"], r["lo"] + r["span"]
                    for b in range((leader - last) // block, r["shift"] // block + 1):
                        near, far = leader - b * block, leader - b * block - block + 1
                        p0, p1 = max(r["lo"], far), min(last, near)
                        rows.append((r["lo"], r["twice"], r["gram"], b, near, far + length, p0, p1))
                lo, twice, gram, b, start, end, p0, p1 = zip(*rows)
                count = np.array(p1) - np.array(p0) + 1
                each = np.repeat(np.array(p0), count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                windows = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(count))).astype(np.int32), _long(names.of(each, each + length)))
                size = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [_long(np.full(size, th)), _long(np.full(size, n)), pa.array(lo, pa.int64()), pa.array(twice), pa.array(gram, pa.int64()), pa.array(b, pa.int32()),
                     _long(names.of(np.array(start), np.array(end))), pa.array(p0, pa.int64()), windows],
                    names=["th", "n", "lo", "twice", "gram", "block", "inner", "first", "names"])

    # only the texts that have such runs are shuffled
    met, _ = C.keyed_rows(known, per_text, ["th", "n"])
    return met.join(per_text, ["th", "n"]).select("th", "n", "text", "runs").mapInArrow(run, BLOCKS)


def repeated(rows: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """Keys that stand at two places or more, or at one that is known to be repeated."""
    at = F.struct(*place)
    return (rows.groupBy(*keys).agg(F.max("twice").alias("twice"), F.min(at).alias("a"), F.max(at).alias("z"))
            .where(F.col("twice") | (F.col("a") != F.col("z"))).select(*keys))


def repeated_spans(known: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """th, n and ``spans`` (start, end; not merged) of every text that has repeated strings, written."""
    runs = C.materialize(find_runs(known, length), "runs")
    again = C.materialize(runs.groupBy("gram").count().where("count > 1").select("gram"), "grams")
    live = C.materialize(runs.join(again, "gram", "left_semi"), "live-runs")
    C.drop(runs, again)
    same = ["gram", "whole", "span", "shift"]
    kinds = C.materialize(live.groupBy(*same).agg(F.count("*").alias("times"), F.min(F.struct("th", "n", "lo")).alias("at")), "run-kinds")
    full = live.join(kinds.where("times > 1").select(*same), same, "left_semi").select("th", "n", F.col("lo").alias("start"), (F.col("lo") + F.col("span") + length).alias("end"))
    full = C.materialize(full, "whole-runs")
    # a run that is alone of its kind may share some windows with the other kinds of its leader's string
    mixed = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 AND least = 1").select("gram")
    wanted = kinds.join(mixed, "gram", "left_semi").select("at.*", "span", "shift", "gram", (F.col("times") > 1).alias("twice"))
    per_text = C.materialize(wanted.groupBy("th", "n").agg(F.collect_list(F.struct("lo", "span", "shift", "gram", "twice")).alias("runs")), "runs-by-text")
    C.drop(live, kinds)
    blocks = C.materialize(name_blocks(known, per_text, length, block), "blocks")
    near = C.materialize(repeated(blocks, ["gram", "block", "inner"], ["th", "n", "lo"]), "near-blocks")
    left = blocks.join(near, ["gram", "block", "inner"], "left_semi").select("th", "n", "twice", "gram", "block", "first", F.posexplode("names").alias("k", "name"))
    windows = C.materialize(left.select("th", "n", "twice", "gram", "block", (F.col("first") + F.col("k")).alias("start"), "name"), "windows")
    C.drop(per_text, blocks, near)
    found = C.materialize(repeated(windows, ["gram", "block", "name"], ["th", "n", "start"]), "repeated-windows")
    part = windows.where(~F.col("twice")).join(found, ["gram", "block", "name"], "left_semi").select("th", "n", "start", (F.col("start") + length).alias("end"))
    # copies of a text come to the same spans: count them once before they meet
    spans = C.materialize(full.union(part).distinct().groupBy("th", "n").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    C.drop(full, windows, found)
    return spans


def positions(known: DataFrame, width: int) -> DataFrame:
    """th, n, at and the next ``width`` (at most 8) bytes as one number, for every place of every text that has them."""
    def run(batches):
        for batch in batches:
            for th, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                for i in range(0, len(raw) - width + 1, SLICE):
                    part = raw[i: i + SLICE + width - 1]
                    m = len(part) - width + 1
                    eights = np.ndarray((m,), "<u8", part + bytes(8), 0, (1,)) & np.uint64((1 << 8 * width) - 1)
                    yield pa.RecordBatch.from_arrays([_long(np.full(m, th)), _long(np.full(m, n)), _long(i + np.arange(m)), _long(eights)], names=["th", "n", "at", "rank"])

    once = known.groupBy("th", "n").agg(F.any_value("text").alias("text"))
    return once.mapInArrow(run, "th long, n long, at long, rank long")


def repeated_by_doubling(known: DataFrame, length: int = LENGTH) -> DataFrame:
    """The spans of ``repeated_spans``, by plain prefix doubling over all byte positions.

    A position's rank at 8 bytes is those bytes.  Each round pairs the rank of a position
    with the rank ``offset`` further on; Spark sorts the pairs, and a pair that stands at
    several positions gets a new rank, the least of them.  What is unique drops out, and
    what begins there has no partner in later rounds.  Offsets double until the pairs cover
    ``length`` bytes; the last offset is shortened to end there.

    A row per byte and round: for texts of some megabytes in all (the README has the check
    tool's figures).  Copies of a text are one text here, all of it repeated."""
    copies = C.materialize(known.groupBy("th", "n").count().where(f"count > 1 AND n >= {length}"), "copied-texts")
    size = min(8, length)
    place = F.struct("th", "n", "at")

    def rerank(pairs: DataFrame, keys: list[str]) -> DataFrame:
        classes = pairs.groupBy(*keys).agg(F.count("*").alias("times"), F.min(place).alias("least")).where("times > 1").select(*keys, F.xxhash64("least.th", "least.n", "least.at").alias("new"))
        return C.materialize(pairs.join(classes, keys).select("th", "n", "at", F.col("new").alias("rank")), "ranks")

    ranks = rerank(C.materialize(positions(known, size), "positions"), ["rank"])
    while size < length:
        offset = min(size, length - size)
        ahead = ranks.select("th", "n", (F.col("at") - offset).alias("at"), F.col("rank").alias("next"))
        wider = rerank(C.materialize(ranks.join(ahead, ["th", "n", "at"]), "pairs"), ["rank", "next"])
        ranks, size = wider, size + offset
    inside = ranks.select("th", "n", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    whole = copies.select("th", "n", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    return C.materialize(inside.union(whole).groupBy("th", "n").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")


def remove_spans(text: bytes, spans: list) -> tuple[bytes, int]:
    """What is left of a text, and how many stretches went."""
    kept, at, gone, end = [], 0, 0, -1
    for s, e in sorted(spans):
        if s > end:
            gone += 1
            kept.append(text[at:s])
        end = max(end, e)
        at = end
    kept.append(text[at:])
    return b"".join(kept), gone


def dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = False, doubling: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; the bytes kept if
    asked for.  ``doubling`` finds the repeats by plain prefix doubling."""
    known = known_by(docs)
    spans = (repeated_by_doubling if doubling else repeated_spans)(known, length)

    def run(batches):
        for batch in batches:
            rows = []
            for text, where in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode()
                kept, gone = remove_spans(raw, [(s["start"], s["end"]) for s in where or ()])
                rows.append((len(raw), len(raw) - len(kept), gone, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) or [(), (), (), (), ()]
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))][: 4 + with_text]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    # texts without a span stay where they are; only the others are shuffled to their spans
    met, rest = C.keyed_rows(known, spans, ["th", "n"])
    out = met.join(spans, ["th", "n"], "left").select("doc_id", "text", "spans").mapInArrow(run, shape)
    if rest is None:
        return out
    whole = rest.select("doc_id", F.col("n").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"),
                        *([F.col("text").cast("binary").alias("kept")] if with_text else []))
    return out.unionByName(whole)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(C.table(spark, sf_dir, "documents"))
