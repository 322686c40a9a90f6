"""Best-fit packing of documents into sequences, with Martello-Toth dominance reduction.

Lengths are whole numbers of tokens up to the capacity, so an instance is fully told by
how many pieces there are of each length: a histogram of at most ``capacity`` numbers,
whatever the corpus size.  ``plan`` solves that instance:

1. dominance reduction: pieces are fixed for good, largest first, wherever a small set
   with them provably dominates every alternative (a full piece alone, a pair that fills
   the capacity, the largest partner where at most one other piece fits, or where no two
   smaller pieces that fit together exceed that partner),
2. best fit, in decreasing length, of what is left; equal bins are handled as one group.

Its answer is a table of rank ranges (length, rank from/to -> sequence, offset).  Its
size is bounded by the capacity alone, so it is broadcast; the pieces are ranked within
their length by Spark, in hash buckets, and look their place up.

NULL text counts as empty (one end id), NULL doc_ids and repeated rows are packed each,
an empty table gives no pieces, other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableprep.llm import _common as C
from tableprep.llm import tokens

CAPACITY = 2048
PIECES = "doc_id long, row_hash long, piece int, start long, length long, ids_crc32 long, twin long"


class Sizes:
    """The instance: how many pieces there are of each length."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.keys = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.keys.remove(size)

    def up_to(self, limit: int) -> int | None:
        """The largest length that fits into ``limit``."""
        i = bisect_left(self.keys, limit + 1)
        return self.keys[i - 1] if i else None

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest pieces, one piece of length ``without`` set aside."""
        out: list[int] = []
        for s in self.keys:
            out += [s] * min(n - len(out), self.count[s] - (s == without))
            if len(out) >= n:
                break
        return out

    def best_pair(self, limit: int, without: int) -> int:
        """The most that two pieces fill of ``limit`` (0: no two fit), one piece of length ``without`` set aside."""
        best, i, j = 0, 0, bisect_left(self.keys, limit + 1) - 1
        while i <= j:
            a, b = self.keys[i], self.keys[j]
            spare = self.count[a] - (a == without) - (a == b), self.count[b] - (b == without)
            if a + b > limit:
                j -= 1
                continue
            if min(spare) > 0:
                best = max(best, a + b)
                i += 1
            elif spare[0] <= 0:
                i += 1
            else:
                j -= 1
        return best


def reduce_dominated(sizes: Sizes, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Fix dominating sets; returns (bins, ((length, pieces per bin), ...)) and leaves the rest in ``sizes``."""
    fixed = []
    for s in sorted(sizes.count, reverse=True):
        while sizes.count.get(s):
            n, room = sizes.count[s], capacity - s
            small = sizes.smallest(3, s)
            mate = sizes.up_to(room)
            if mate == s and n == 1:
                i = sizes.keys.index(s)
                mate = sizes.keys[i - 1] if i else None
            if mate is None or not small or small[0] > room:  # nothing fits beside it
                times, parts = n, ((s, 1),)
            elif mate == room or len(small) < 2 or small[0] + small[1] > room or (
                    (len(small) < 3 or sum(small) > room) and sizes.best_pair(room, s) <= mate):
                times, parts = (n // 2, ((s, 2),)) if mate == s else (min(n, sizes.count[mate]), ((s, 1), (mate, 1)))
                if mate != room:  # the proof looks at what is left now, so one set at a time unless nothing else fits at all
                    times = times if len(small) > 1 and small[0] + small[1] > room else 1
            else:
                break
            for size, k in parts:
                sizes.take(size, k * times)
            fixed.append((times, parts))
    return fixed


def best_fit(sizes: Sizes, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best fit in decreasing length; bins with one history are one group."""
    open_: dict[int, list] = defaultdict(list)  # room -> [[bins, parts], ...]
    rooms: list[int] = []

    def put(room: int, bins: int, parts: tuple) -> None:
        if room not in open_ or not open_[room]:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([bins, parts])

    for s in sorted(sizes.count, reverse=True):
        left = sizes.count[s]
        moved = []
        while left:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                bins, parts = open_[room].pop()
                if not open_[room]:
                    rooms.pop(i)
            else:
                room, bins, parts = capacity, -(-left // (capacity // s)), ()
            each = room // s
            whole = min(bins, left // each)
            if whole:
                moved.append((room - each * s, whole, parts + ((s, each),)))
                left -= whole * each
            if bins > whole:
                some = left if left < each and whole < bins else 0
                if some:
                    moved.append((room - some * s, 1, parts + ((s, some),)))
                    left = 0
                if bins - whole - bool(some) and parts:
                    put(room, bins - whole - bool(some), parts)
        for room, bins, parts in moved:
            put(room, bins, parts)
    return [(bins, parts) for room in rooms for bins, parts in open_[room]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank_from, rank_to, each, first_sequence, offset): piece r of a length goes to
    sequence ``first + (r - rank_from) // each`` at ``offset + (r - rank_from) % each * length``."""
    sizes = Sizes(counts)
    groups = reduce_dominated(sizes, capacity)
    groups += best_fit(sizes, capacity)
    merged: dict[tuple, int] = defaultdict(int)
    for bins, parts in groups:
        merged[parts] += bins
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for parts, bins in merged.items():
        offset = 0
        for s, k in parts:
            out.append((s, used[s], used[s] + bins * k, k, sequence, offset))
            used[s] += bins * k
            offset += s * k
        sequence += bins
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokens of every document, cut into pieces of at most ``capacity``."""
    def run(batches):
        enc, end, seq = tokens.encoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, hashes, at = batch.column(0).cast(pa.int64()), batch.column(1), 0
            for group in tokens.text_groups(batch.column(2).to_pylist()):
                row, piece, raw = [], [], []
                for i, coded in enumerate(enc.encode(group)):
                    coded += end
                    for k, b in enumerate(range(0, len(coded), 4 * capacity)):
                        row.append(at + i)
                        piece.append(k)
                        raw.append(coded[b: b + 4 * capacity])
                at += len(group)
                take = pa.array(row, pa.int64())
                k = np.array(piece, np.int64)
                cols = [ids.take(take), hashes.take(take), pa.array(k.astype(np.int32)), pa.array(k * capacity),
                        pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                        pa.array(seq + np.arange(len(raw)))]
                seq += len(raw)
                yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids,
                                                 names=["doc_id", "row_hash", "piece", "start", "length", "ids_crc32", "twin"] + ["ids"] * with_ids)

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def rank_in_length(df: DataFrame) -> DataFrame:
    """``rank``: number of the piece among those of its length, from 0.  A length that a
    third of all pieces share is dealt over hash buckets, whose counts are summed first;
    ``twin`` numbers the pieces, so that equal ones are dealt as well."""
    buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    df = df.withColumn("bucket", F.pmod(F.xxhash64("row_hash", "piece", "twin"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = df.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("row_hash", "doc_id", "piece", "twin")
    ranked = df.withColumn("inside", F.row_number().over(inside) - 1)
    return ranked.join(first, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("inside")).drop("bucket", "first", "inside")


def pack(table: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a (materialised) table of pieces with a ``length``."""
    counts = {r.length: r["count"] for r in table.groupBy("length").count().collect()}  # at most `capacity` rows
    rows: dict[int, list] = defaultdict(list)
    for s, lo, hi, each, sequence, offset in plan(counts, capacity):
        rows[s].append((lo, hi, each, sequence, offset))
    ranged = table.sparkSession.createDataFrame(
        [(s, lo, hi, each, sequence, offset) for s, group in rows.items() for lo, hi, each, sequence, offset in group],
        "length long, lo long, hi long, each long, first long, at long")
    # bounded by the capacity (see the module text), not by the corpus
    hit = rank_in_length(table).join(F.broadcast(ranged), "length").where("rank >= lo AND rank < hi")
    return hit.select(*table.columns, (F.col("first") + F.expr("(rank - lo) div each")).alias("sequence_id"),
                      (F.col("at") + F.expr("(rank - lo) % each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    cut = C.materialize(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    return pack(cut, capacity).drop("row_hash", "twin")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
