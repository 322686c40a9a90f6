import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableprep.llm import fill_middle as M

from .conftest import DOCS


def plain(doc_id, text, fim=100, spm=50, seed=7):
    """The contract, with a list of the lines."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(s in text for s in M.SENTINELS) or h[2] % 100 >= fim:
        return len(units), "plain", None, None, text
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}") if h[3] % 100 < spm else (len(units), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}")


TEXT = st.one_of(st.none(), st.text(st.sampled_from("ab\n\né€😀<PSM>\r"), max_size=80), st.text(max_size=30))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(1, 9), st.data())
def test_cuts_against_lines(texts, block, data):
    docs = [t or "" for t in texts]
    buffer = "".join(docs).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in docs)])
    got = M.Texts(np.frombuffer(buffer, np.uint8), offsets, block)
    lines = [re.findall(r"[^\n]*\n|[^\n]+", t) for t in docs]
    assert got.counts().tolist() == [len(u) for u in lines]
    if docs:
        k = np.array([data.draw(st.integers(0, len(u))) for u in lines])
        at = got.cut(np.arange(len(docs)), k)
        assert [buffer[o:a].decode() for o, a in zip(offsets, at)] == ["".join(u[:i]) for u, i in zip(lines, k)]
        assert got.code_points(offsets[:-1], at).tolist() == [len("".join(u[:i])) for u, i in zip(lines, k)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40))
def test_fenwick(counts):
    tree, ranks = M.Fenwick(np.array(counts)), np.arange(1, sum(counts) + 1)
    assert tree.before(np.arange(len(counts) + 1)).tolist() == [sum(counts[:i]) for i in range(len(counts) + 1)]
    where = [(b, r + 1) for b, c in enumerate(counts) for r in range(c)]
    assert list(zip(*(x.tolist() for x in tree.find(ranks)))) == where


@pytest.mark.parametrize("fim, spm", [(100, 50), (40, 100), (0, 50)])
def test_documents(spark, odd_docs, docs, fim, spm):
    few = docs.limit(150).select("doc_id", "text")  # the whole table is held against SQL
    tricky = spark.createDataFrame([(50 + i, t) for i, t in enumerate(["a\nb <P\n>c\n", "<\nS>x\n", "has <M> in it\n", "\n\n\n", "😀\né\r\nend"])], "doc_id long, text string")
    rows = odd_docs.select("doc_id", "text").union(few).union(tricky)
    got = M.transform_documents(rows.selectExpr("*", "1 AS n", "'x' AS form", "2 AS output", "3 AS h0"), fim_percent=fim, spm_percent=spm)
    got = got.withColumn("again", M.restored()).collect()
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    want = [(i, *plain(i, t, fim, spm), t or "") for i, t in texts]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_very_long_text(spark):
    text = "\n".join(f"line {i} é😀" for i in range(700_000))  # longer than SLICE
    assert len(text.encode()) > 2 * M.SLICE
    batch = M.transform_batch(pa.array([text, "", "one\ntwo\n"]), [np.array([x] * 3) for x in (350_001, 20_011, 0, 0)], M.SENTINELS, 100, 50)
    rows = pa.Table.from_batches(batch).to_pylist()
    lines = text.splitlines(keepends=True)
    assert rows[0]["n"] == 700_000 and rows[0]["prefix_chars"] == len("".join(lines[:20_011])) and rows[0]["middle_chars"] == len("".join(lines[20_011:350_001]))
    df = spark.createDataFrame([(rows[0]["output"], "spm")], "output string, form string")
    assert df.select(F.sha2(M.restored(), 256)).first()[0] == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(no_docs, spark):
    assert M.transform_documents(no_docs).collect() == []
    assert M.transform_documents(spark.createDataFrame([], DOCS)).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
