"""SimHash near-duplicates found through a Gray-order hierarchical index.

Fingerprints: 64 bits, bit b set if it is set in over half the XXH64 hashes (seed 42) of
the word shingles, repeats included.  Two fingerprints link at ``distance`` or fewer
differing bits.

The index: the 64 bits are cut into ``distance + 2`` fields, so two linked fingerprints
agree on at least two whole fields; for every pair of fields the fingerprints are written
with those two in front and sorted by the rank of that word in the Gray code.  Equal
fronts are then neighbours, and neighbours differ in few bits.  Runs of one front are cut
into leaves and leaves into nodes; a node keeps the bits all its members share (mask and
pattern), a leaf only what it shares beyond its node.  Going down, the differences in the
shared bits add up, and whole nodes and leaves whose sum exceeds ``distance`` are left
out; only what remains is compared member by member.  Nodes of one front meet by an
equi-join of their masks, filtered by ``bit_count``, before any member is shipped, so a
front that a third of all fingerprints share is split over as many tasks as it has nodes.

Links are handed on as a spanning forest of each comparison, never as all pairs, and
joined up by ``components``.  Copies count once: only distinct fingerprints are indexed.

NULL text counts as empty: no words, fingerprint zero, linked like any other.  NULL
doc_ids get a fingerprint and count for no minimum; repeated rows are kept each; an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm import _common as C
from tableprep.llm.components import components

LEAF, NODE = 128, 4096  # members of a leaf and of a node
SHINGLE, DISTANCE = 3, 3

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-1].tolist()]
        hashes = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    each = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(each[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text) and fp of every document."""
    def run(batches):
        for batch in batches:
            data, off = C.utf8_batch(batch.column(2))
            raw = data.tobytes()
            fps = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def fronts(distance: int) -> list[tuple[np.ndarray, int]]:
    """For each pair of fields: the bits of a fingerprint in their new order (highest first), and how many stand in front."""
    fields = np.array_split(np.arange(63, -1, -1), distance + 2)
    return [(np.concatenate([fields[i], fields[j], *(f for k, f in enumerate(fields) if k not in (i, j))]), len(fields[i]) + len(fields[j]))
            for i, j in combinations(range(len(fields)), 2)]


def reorder(fps: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.zeros_like(fps)
    for bit in order:
        out = (out << np.uint64(1)) | ((fps >> np.uint64(bit)) & np.uint64(1))
    return out


def gray_rank(words: np.ndarray) -> np.ndarray:
    """Place of each word in the Gray code: its prefix parities."""
    for by in (1, 2, 4, 8, 16, 32):
        words = words ^ (words >> np.uint64(by))
    return words


def shared(fps: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Bits that all members share, and their pattern."""
    mask = ~(np.bitwise_or.reduce(fps) ^ np.bitwise_and.reduce(fps))
    return mask, fps[0] & mask


def forest(links: np.ndarray) -> np.ndarray:
    """Least connected index of each row of a symmetric boolean matrix."""
    n = len(links)
    label = np.arange(n)
    reach = links | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, label[None, :], n).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= distance


def _emit(members: np.ndarray, links: np.ndarray, out: list) -> None:
    label = forest(links)
    child = np.flatnonzero(label != np.arange(len(label)))
    out.append(np.stack([members[child], members[label[child]]]))


class Node:
    """A run of fingerprints in Gray order: the shared bits on top, and below them, leaf by leaf, what else is shared."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.mask, self.pattern = shared(fps)
        self.cuts = range(0, len(fps), LEAF)
        own = [shared(fps[i: i + LEAF]) for i in self.cuts]
        self.leaf_mask = np.array([m & ~self.mask for m, _ in own], np.uint64)
        self.leaf_pattern = np.array([p & ~self.mask for _, p in own], np.uint64)

    def leaf(self, i: int) -> np.ndarray:
        return self.fps[i * LEAF: (i + 1) * LEAF]


def compare(a: Node, b: Node, distance: int, out: list) -> None:
    """Links between two nodes, or inside one (``a is b``)."""
    common = a.mask & b.mask
    base = int(np.bitwise_count((a.pattern ^ b.pattern) & common))
    if base > distance:
        return
    # beyond the node's shared bits a leaf's pattern may stand on bits that only the other node shares
    am, ap = (a.leaf_mask | a.mask) & ~common, (a.leaf_pattern | a.pattern) & ~common
    bm, bp = (b.leaf_mask | b.mask) & ~common, (b.leaf_pattern | b.pattern) & ~common
    more = np.bitwise_count((ap[:, None] ^ bp[None, :]) & am[:, None] & bm[None, :])
    for i, j in np.argwhere(base + more <= distance):
        if a is b and j < i:
            continue
        x, y = a.leaf(i), b.leaf(j)
        near = _near(x, y, distance)
        if a is b and i == j:
            if near.sum() > len(x):
                _emit(x, near, out)
        elif near.any():
            rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            both = np.zeros((len(rows) + len(cols),) * 2, bool)
            both[: len(rows), len(rows):] = near[np.ix_(rows, cols)]
            _emit(np.concatenate([x[rows], y[cols]]), both | both.T, out)


def _links(out: list) -> pa.RecordBatch:
    pairs = np.concatenate(out, 1) if out else np.zeros((2, 0), np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], names=["u", "v"])


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (u, v) that connect all fingerprints within ``distance`` of each other.  ``fps``: distinct, column ``fp``."""
    spark, views = fps.sparkSession, fronts(distance)

    def write_out(batches):
        for batch in batches:
            words = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for view, (order, _) in enumerate(views):
                rank = gray_rank(reorder(words, order))
                # flip the top bit: Spark compares signed longs
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), view, np.int32)), pa.array((rank ^ np.uint64(1 << 63)).view(np.int64)), batch.column(0)],
                                                 names=["view", "rank", "fp"])

    ranked = fps.select("fp").mapInArrow(write_out, "view int, rank long, fp long")
    ranked = ranked.repartitionByRange("view", "rank").sortWithinPartitions("view", "rank")

    def nodes(batches):
        held: list[tuple] = []

        def run_of(views_, fronts_, fps_, edge):
            """Nodes of one front; a lone fingerprint matters only where its front may go on in the next task."""
            for i in range(0, len(fps_), NODE):
                part = fps_[i: i + NODE]
                if len(fps_) > 1 or edge:
                    mask, pattern = shared(part)
                    held.append((int(views_), int(fronts_), int(part[0].view(np.int64)), int(mask.view(np.int64)), int(pattern.view(np.int64)), part.tobytes()))

        def flush():
            rows = pa.RecordBatch.from_pylist([dict(zip(("view", "front", "node", "mask", "pattern", "members"), h)) for h in held], schema=schema)
            held.clear()
            return rows

        schema = pa.schema([("view", pa.int32()), ("front", pa.int64()), ("node", pa.int64()), ("mask", pa.int64()), ("pattern", pa.int64()), ("members", pa.binary())])
        rest, first = None, True
        for batch in batches:
            view = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)
            words = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            front = rank >> np.array([64 - n for _, n in views], np.uint64)[view]
            if rest:
                view, front, words = np.concatenate([rest[0], view]), np.concatenate([rest[1], front]), np.concatenate([rest[2], words])
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(view) != 0) | (np.diff(front) != 0)) + 1))
            ends = np.concatenate((cuts[1:], [len(view)]))
            for k in range(len(cuts) - 1):
                if ends[k] - cuts[k] > 1 or first:
                    run_of(view[cuts[k]], front[cuts[k]], words[cuts[k]: ends[k]], first)
                first = False
            a = cuts[-1]
            while len(view) - a > 4 * NODE:  # a very common front doesn't pile up here
                run_of(view[a], front[a], words[a: a + NODE], True)
                a, first = a + NODE, False
            rest = (view[a:], front[a:], words[a:])
            if len(held) > 1000:
                yield flush()
        if rest and len(rest[2]):
            run_of(rest[0][0], rest[1][0], rest[2], True)
        if held:
            yield flush()

    tree = C.materialize(ranked.mapInArrow(nodes, "view int, front long, node long, mask long, pattern long, members binary"), "gray-nodes")

    def inside(batches):
        for batch in batches:
            out: list = []
            for members in batch.column(0).to_pylist():
                node = Node(np.frombuffer(members, np.uint64))
                compare(node, node, distance, out)
            yield _links(out)

    def across(batches):
        for batch in batches:
            out: list = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                compare(Node(np.frombuffer(x, np.uint64)), Node(np.frombuffer(y, np.uint64)), distance, out)
            yield _links(out)

    tops = tree.select("view", "front", "node", "mask", "pattern")
    pairs = (tops.alias("a").join(tops.alias("b"), ["view", "front"]).where("a.node < b.node")
             .where(F.bit_count(F.expr("(a.pattern ^ b.pattern) & a.mask & b.mask")) <= distance)
             .select("view", F.col("a.node").alias("na"), F.col("b.node").alias("nb")))
    members = tree.select("view", "node", "members")
    met = (pairs.join(members.toDF("view", "na", "x"), ["view", "na"]).join(members.toDF("view", "nb", "y"), ["view", "nb"]))
    return tree.select("members").mapInArrow(inside, "u long, v long").union(met.select("x", "y").mapInArrow(across, "u long, v long"))


def groups(signed: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp, component_id (least doc_id) and root for every distinct fingerprint of a (materialised) signature table."""
    distinct = C.materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    linked = components(near_links(distinct, distance))
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that Spark can split the rows of a very large component in the join below
    named = C.materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    return rooted.join(named, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, text_hash, fp, component_id and root (the fingerprint that names the group) of every document."""
    signed = C.materialize(signatures(docs, shingle), "signatures")
    return signed.join(groups(signed, distance), "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The documents without their near-duplicates: of each group the row of the least doc_id (NULL last), then text hash, stays."""
    found = near_duplicates(docs, shingle, distance)
    d, h, here = (C.fresh(c, docs.columns) for c in ("kept_id", "kept_hash", "text_hash"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h")))
    kept = found.groupBy("root").agg(first.alias("k")).select(F.col("k.d").alias(d), F.col("k.h").alias(h)).distinct()
    rows = docs.withColumn(here, F.xxhash64("text"))
    rows = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(here) == F.col(h)), "left_semi")
    # rows that repeat one another in id and text are one document
    return rows.dropDuplicates(["doc_id", here]).drop(here)


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
