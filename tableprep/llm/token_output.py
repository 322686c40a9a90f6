"""Token-ID / binary output: documents as rANS-coded blocks of token ids.

``write_tokens`` tokenises the documents once, counts every id over the whole corpus,
puts the documents' ids (not their texts) in ascending ``doc_id`` order, and codes runs of
documents into independent blocks (``rans`` describes their bytes) under one shared
frequency table.  Rows of one ``doc_id`` are ordered by the crc32 of their ids and then by
a number of their own, so a ``doc_id`` or a row that a third of the table repeats is dealt
over many ranges.  A folder holds
``blocks`` (one row per block, written by Spark's own committer so a lost executor leaves
no half file), and ``table`` (symbol, count, freq).  ``read_tokens`` decodes it again.

NULL text counts as empty (only the end id), NULL doc_id sorts first, repeated rows are
kept each, an empty table gives an empty folder, other columns of the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm import _common as C
from tableprep.llm import rans, tokens

BLOCK_TOKENS = 1 << 18
BITS = 20
MEMO_WORDS = 2_000_000  # pieces in a worker's table, about 60 bytes each: nothing else runs in these tasks

IDS = "doc_id long, n_tokens long, crc long, twin long, ids binary"
BLOCKS = "part int, seq long, before long, n_docs long, n_tokens long, payload binary"
DOCS = "part int, doc_id long, before long, n_tokens long, ids_crc32 long"


def encode_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Ids of every document (with the end id), as they come; ``twin`` numbers the rows."""
    kind = "<u2" if tokens.vocab_size(tokenizer) <= 1 << 16 else "<u4"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc, seq = tokens.encoder(tokenizer, MEMO_WORDS), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, at = batch.column(0), 0
            for group in tokens.text_groups(batch.column(1).to_pylist(), 4 << 20):
                raw = [b + end for b in enc.encode(group)]
                narrow = [np.frombuffer(r, "<u4").astype(kind).tobytes() for r in raw]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(raw)).cast(pa.int64()), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                    pa.array(seq + np.arange(len(raw))), pa.array(narrow, pa.binary())], names=["doc_id", "n_tokens", "crc", "twin", "ids"])
                seq, at = seq + len(raw), at + len(raw)

    return C.materialize(docs.select("doc_id", "text").mapInArrow(run, IDS), "token-ids")


def count_ids(coded: DataFrame, kind: str) -> DataFrame:
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column(0)
            _, off, data = ids.buffers()
            off = np.frombuffer(off, np.int32)[ids.offset: ids.offset + len(ids) + 1]
            n = np.bincount(np.frombuffer(data, np.uint8)[off[0]: off[-1]].view(kind)) if len(ids) else total[:0]
            if len(n) < len(total):
                n, total = total, n
            n[: len(total)] += total
            total = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], names=["symbol", "n"])

    return coded.select("ids").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block_tokens: int = BLOCK_TOKENS, bits: int = BITS) -> None:
    spark = docs.sparkSession
    kind = "<u2" if tokens.vocab_size(tokenizer) <= 1 << 16 else "<u4"
    coded = encode_ids(docs, tokenizer, end_id)
    # at most one row per vocabulary entry reaches the driver
    counts = np.array([(r.symbol, r.n) for r in count_ids(coded, kind).collect()], np.int64).reshape(-1, 2)
    counts = counts[np.argsort(counts[:, 0])]
    freqs = rans.quantise(counts[:, 0], counts[:, 1], bits)
    spark.createDataFrame([(int(s), int(n), int(f), bits) for (s, n), f in zip(counts, freqs)], "symbol long, n long, freq long, bits int").coalesce(1).write.parquet(f"{path}/table")
    table = (counts[:, 0], freqs, bits)

    def run(batches):
        shared, part, seq, before = rans.Table(*table), TaskContext.get().partitionId(), 0, 0
        held, size = [], 0

        def block():
            ids = np.concatenate([h[2] for h in held]).astype(np.int64)
            payload = rans.encode_block(shared, [h[0] for h in held], [h[1] for h in held], ids)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "before": before, "n_docs": len(held), "n_tokens": size, "payload": payload}], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for doc_id, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if held and size + n > block_tokens:
                    yield block()
                    held, seq, before, size = [], seq + len(held), before + size, 0
                held.append((doc_id, n, np.frombuffer(ids, kind)))
                size += n
        if held:
            yield block()

    order = ("doc_id", "crc", "twin")
    placed = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select("doc_id", "n_tokens", "ids").mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode a folder of ``write_tokens``: one row per document, with its ids if asked for."""
    rows = spark.read.parquet(f"{path}/table").collect()
    table = ([r.symbol for r in rows], [r.freq for r in rows], rows[0].bits if rows else BITS)

    def run(batches):
        shared = rans.Table(*table)
        for batch in batches:
            for part, before, payload in zip(*(c.to_pylist() for c in batch.columns)):
                block = rans.Block(shared, payload)
                ids, n = block.ids(), block.lengths
                ends = np.cumsum(n)
                raw = [ids[e - k: e].tobytes() for e, k in zip(ends, n)]
                cols = [pa.array(np.full(len(n), part, np.int32)), pa.array(block.doc_ids, pa.int64()), pa.array(before + ends - n), pa.array(n),
                        pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids, names=["part", "doc_id", "before", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("part", "before", "payload").mapInArrow(run, DOCS + (", ids binary" if with_ids else ""))


def block_range(block: rans.Block, first: int, last: int) -> np.ndarray:
    """Ids first to last (not included) of a block, from the segments between checkpoints that hold them."""
    step = block.stride * block.lanes
    first, last = max(first, 0), min(last, block.tokens)
    if first >= last:
        return np.zeros(0, "<u4")
    k = first // step
    return np.concatenate([block.segment(i) for i in range(k, (last - 1) // step + 1)])[first - k * step: last - k * step]


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(start, ids): the corpus's ids from ``first`` to ``last`` (not included), a row for each
    block that holds some.  Other blocks aren't read, and of these only the needed segments are decoded."""
    rows = spark.read.parquet(f"{path}/table").collect()
    table = ([r.symbol for r in rows], [r.freq for r in rows], rows[0].bits if rows else BITS)
    starts = spark.createDataFrame(list(part_starts(spark, path).items()), "part int, base long")

    def run(batches):
        shared = rans.Table(*table)
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = block_range(rans.Block(shared, payload), first - start, last - start)
                yield pa.RecordBatch.from_arrays([pa.array([max(start, first)], pa.int64()), pa.array([ids.tobytes()], pa.binary())], names=["start", "ids"])

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").join(F.broadcast(starts), "part")
    start = F.col("base") + F.col("before")
    return blocks.where((start < last) & (start + F.col("n_tokens") > first)).select(start.alias("start"), "payload").mapInArrow(run, "start long, ids binary")


def part_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each part: one row per write partition, in doc_id order."""
    rows = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    out, total = {}, 0
    for r in rows:
        out[r.part] = total
        total += r.n
    return out


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all from the files."""
    starts = spark.createDataFrame(list(part_starts(spark, path).items()), "part int, base long")
    # one row per write partition: bounded by the partition count of one shuffle
    return (read_tokens(spark, path).join(F.broadcast(starts), "part")
            .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = C.scratch(spark, "rans")
    write_tokens(C.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digest(spark, path)
