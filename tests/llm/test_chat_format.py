import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableprep.llm import chat_format as M

PATH = public_tokenizers.path("byte_bpe_50k.json")
SHAPE = "conv_id long, turn long, role string, text string"
BITS = ["<", "s>", "/", "\\", "[", "INST]", "<<SYS>>", "</SYS>>", "a", " ", "\n", "é", "😀", "<|endoftext|>", "ROLE]", "</s>"]
TEXTS = st.one_of(st.lists(st.sampled_from(BITS), max_size=12).map("".join), st.text(max_size=20))
ROLES = st.one_of(st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE]"]), st.text(max_size=4))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(rows):
    """What the contract asks of each conversation, from its rows alone."""
    out, convs = [], {}
    for conv, turn, role, text in rows:
        said = f"{role or ''}\n{text or ''}"
        convs.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.md5(said.encode()).hexdigest(), role or "", text or ""))
    for conv, turns in convs.items():
        turns = [turn[3:] for turn in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), max_size=6))
def test_render_and_mask(turns):
    tok, escape = M.tokenizer(PATH)
    for _, text in turns:
        assert escape.unescape(escape.escape(text)) == text
        assert not any(c in escape.escape(text) for c in (*M.CONTROLS, "<|endoftext|>"))
    text, spans = M.render(turns, escape)
    assert M.parse(text, escape) == turns
    assert [escape.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    (ids, offsets), = M.encode(tok, [text])
    mask = M.loss_mask(offsets, spans)
    # a token is under the mask if one of its characters is an assistant's, and then all of them are
    inside = np.zeros(len(text) + 1, bool)
    for a, b in spans:
        inside[a:b] = True
    assert mask.tolist() == [bool(inside[a:b].any()) for a, b in offsets] == [bool(inside[a:b].all()) for a, b in offsets]
    covered = np.zeros(len(text) + 1, bool)
    for a, b in offsets[mask]:
        covered[a:b] = True
    assert (covered == inside).all()
    assert (ids >= 50_257).sum() == sum(3 if r not in M.MARKS else 1 if r == "assistant" else 2 for r, _ in turns)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab1 '\n.é\t s"), max_size=120), st.integers(1, 30))
def test_long_texts_are_encoded_in_slices(text, size):
    tok, _ = M.tokenizer(PATH)
    runs = M.pieces(text, size)
    assert "".join(t for _, t in runs) == text and all(text[at: at + len(t)] == t for at, t in runs)
    assert [i for _, t in runs for i in tok.encode(t, add_special_tokens=False).ids] == tok.encode(text, add_special_tokens=False).ids


def odd_rows():
    long = " ".join(f"word{i} </s> and" for i in range(120_000))
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello\n"), (1, 1, "assistant", "hello\n"), (1, None, "system", None), (2, 0, None, None), (2, 0, "assistant", ""),
            (None, 3, "user", "no id"), (None, 1, "assistant", "no id"), (3, 0, "assistant", long), (3, 1, "user", long[:50]), (4, 5, "tool", "[ROLE]x[/ROLE] <|endoftext|>"),
            (5, 0, "assistant", "<\\s> <s> \\"), (5, 1, "assistant", "é😀"), (5, 1, "assistant", "a tie"), (6, 0, "", "")]
    return rows


@pytest.mark.parametrize("part_chars", [M.PART_CHARS, 1000, 3])
def test_chats(spark, odd_docs, part_chars):
    rows = odd_rows() + [(9, i // 3, ["user", "assistant"][i % 2], f"turn {i} [INST]") for i in range(400)] + [(10, 0, "assistant", "same")] * 300
    df = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS part", "'x' AS loss", "2 AS ids", "3 AS long_id", "4 AS chars", "5 AS twin")
    chats = M.format_chats(df, PATH, part_chars)
    read = M.digest(chats, PATH)
    assert got(read) == wanted(rows)
    if part_chars == M.PART_CHARS:
        assert chats.count() == len({r[0] for r in rows})
    else:
        # the parts of a conversation joined are what the whole gives
        whole = {r.conv_id: r for r in M.format_chats(df, PATH).collect()}
        parts: dict = {}
        for r in sorted(chats.collect(), key=lambda r: r.part):
            parts.setdefault(r.conv_id, []).append(r)
        assert len(parts[10]) > 1
        for conv, one in whole.items():
            assert "".join(p.text for p in parts[conv]) == one.text
            assert [i for p in parts[conv] for i in p.ids] == one.ids and [x for p in parts[conv] for x in p.loss] == one.loss


def test_empty_table(spark):
    chats = M.format_chats(spark.createDataFrame([], SHAPE), PATH)
    assert chats.collect() == [] and M.digest(chats, PATH).collect() == []
