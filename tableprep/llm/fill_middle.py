"""Fill-in-middle transformation: documents cut at two unit ends and put in another order.

A batch of texts is one byte buffer, cut into fixed blocks.  Two Fenwick trees over the
blocks hold how many units (lines) end and how many code points begin in each.  A
binary-lifting descent finds the block in which the wanted unit ends, and the place inside
that block is looked up locally; the code points before a place come from the other tree
and a local count.  All cuts of a batch go down the tree together, so the work is the
bytes plus a logarithm per cut, and a text of any length is one buffer, never a list of
its lines.

The cuts and the form are functions of ``seed`` and ``doc_id`` alone, so a task that runs
again after a lost executor gives the same rows.  The pass is narrow: no shuffle.

NULL text counts as empty and stays ``plain``, and so does a text that holds a sentinel;
a NULL doc_id hashes as the empty id; repeated rows are transformed each and alike; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm import _common as C

SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix, the middle
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
BLOCK = 256  # bytes
SLICE = 4 << 20  # bytes of text worked at once; a longer text is worked alone
CUTS = 1 << 14  # cuts whose blocks are looked into at once

OUTPUT = "n long, form string, prefix_chars long, middle_chars long, output string"


class Fenwick:
    """Counts per block under partial sums: prefix sums and descents of many positions at once."""

    def __init__(self, counts: np.ndarray):
        before = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(len(before))
        self.tree = before - before[at - (at & -at)]

    def before(self, blocks: np.ndarray) -> np.ndarray:
        """Sum over the blocks in front of each given one."""
        at, total = blocks.copy(), np.zeros(len(blocks), np.int64)
        while at.any():
            total += self.tree[at]
            at -= at & -at
        return total

    def find(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that holds the rank-th counted thing (from 1), and its rank inside that block."""
        n, rest = len(self.tree) - 1, rank.copy()
        at, step = np.zeros(len(rank), np.int64), 1 << n.bit_length()
        while step := step >> 1:
            below = at + step
            fits = below <= n
            fits[fits] = self.tree[below[fits]] < rest[fits]
            rest -= np.where(fits, self.tree[np.where(fits, below, 0)], 0)
            at = np.where(fits, below, at)
        return at, rest


class Texts:
    """Units and code points of the texts in one buffer."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK):
        self.block, self.offsets = block, offsets
        size = -(-max(len(data), 1) // block) * block
        self.ends, self.heads = np.zeros(size, bool), np.zeros(size, bool)
        self.ends[: len(data)] = data == 10
        self.ends[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True  # the last line of a text needs no newline
        self.heads[: len(data)] = (data & 0xC0) != 0x80
        self.units, self.points = (Fenwick(x.reshape(-1, block).sum(1, dtype=np.int64)) for x in (self.ends, self.heads))
        self.first = self._count(self.units, self.ends, offsets)  # units before each text

    def _count(self, tree: Fenwick, marks: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Marks before each place: whole blocks by the tree, the rest of the place's own block by looking."""
        blocks, out = places // self.block, np.zeros(len(places), np.int64)
        rows, width = marks.reshape(-1, self.block), np.arange(self.block)
        for i in range(0, len(places), CUTS):
            b, at = blocks[i: i + CUTS], places[i: i + CUTS] % self.block
            inside = rows[np.minimum(b, len(rows) - 1)] & (width < at[:, None])
            out[i: i + CUTS] = tree.before(b) + inside.sum(1)
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def cut(self, text: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The byte after the given number of units of each text."""
        out, some = self.offsets[text].copy(), units > 0
        block, rank = self.units.find(self.first[text[some]] + units[some])
        rows, found = self.ends.reshape(-1, self.block), np.zeros(len(block), np.int64)
        for i in range(0, len(block), CUTS):
            found[i: i + CUTS] = (np.cumsum(rows[block[i: i + CUTS]], axis=1, dtype=np.int32) >= rank[i: i + CUTS, None]).argmax(1)
        out[some] = block * self.block + found + 1
        return out

    def code_points(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._count(self.points, self.heads, end) - self._count(self.points, self.heads, start)


def draws(doc_id: str | Column, seed: int = SEED) -> list[Column]:
    """Four 32-bit numbers of a document: the first groups of the sha256 of ``seed:doc_id``."""
    name = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform_batch(column: pa.Array, h: list[np.ndarray], sentinels: tuple[str, str, str], fim_percent: int, spm_percent: int) -> list[pa.RecordBatch]:
    data, offsets = C.utf8_batch(column)
    before_prefix, before_suffix, before_middle = marks = [s.encode() for s in sentinels]
    out = []
    for i, j in C.slices(offsets, SLICE):
        off = offsets[i: j + 1] - offsets[i]
        part = data[offsets[i]: offsets[j]]
        texts, raw, every = Texts(part, off), part.tobytes(), np.arange(j - i)
        n = texts.counts()
        ends = np.sort(np.stack([h[0][i:j] % (n + 1), h[1][i:j] % (n + 1)]), axis=0)
        a, b = (texts.cut(every, e) for e in ends)
        prefix, middle = texts.code_points(off[:-1], a), texts.code_points(a, b)
        spm = h[3][i:j] % 100 < spm_percent
        plain = (n == 0) | (h[2][i:j] % 100 >= fim_percent)
        rows = []
        for k, (x, p, q, y) in enumerate(zip(off[:-1].tolist(), a.tolist(), b.tolist(), off[1:].tolist())):
            plain[k] = plain[k] or any(raw.find(m, x, y) >= 0 for m in marks)
            if plain[k]:
                rows.append(raw[x:y])
            elif spm[k]:
                rows.append(b"".join((before_suffix, raw[q:y], before_prefix, raw[x:p], before_middle, raw[p:q])))
            else:
                rows.append(b"".join((before_prefix, raw[x:p], before_suffix, raw[q:y], before_middle, raw[p:q])))
        form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
        out.append(pa.RecordBatch.from_arrays([
            pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain),
            pa.array(rows, pa.binary()).cast(pa.string())], names=["n", "form", "prefix_chars", "middle_chars", "output"]))
    return out


def transform_documents(docs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output of every document."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            h = [batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(4)]
            at = 0
            for part in transform_batch(batch.column(1), h, sentinels, fim_percent, spm_percent):
                ids = batch.column(0).slice(at, part.num_rows)
                yield pa.RecordBatch.from_arrays([ids, *part.columns], names=["doc_id", *part.schema.names])
                at += part.num_rows

    rows = docs.select("doc_id", "text", *(c.alias(f"h{k}") for k, c in enumerate(draws("doc_id", seed))))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {OUTPUT}")


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from a transformed document alone.  No sentinel stands in a cut text
    and none can arise where a piece meets a sentinel, so the first of each is the mark."""
    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands after ``first`` (at the start), after ``second``, and after the middle's mark."""
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + F.lit(len(second) + 1))
        two = F.substring_index(rest, sentinels[2], 1)
        return one, two, F.substr(rest, F.length(two) + F.lit(len(sentinels[2]) + 1))

    prefix, suffix, middle = parts(sentinels[0], sentinels[1])
    later, earlier, between = parts(sentinels[1], sentinels[0])
    return (F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix)).when(F.col(form) == "spm", F.concat(earlier, between, later))
            .otherwise(F.col(output)))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transform_documents(C.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT doc_id, t, units, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
