"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one text, which is encoded once with character offsets.  The
loss mask marks the tokens that meet an assistant's text: the spans of the turns and of
the tokens are both sorted, so two binary searches per turn find its tokens.

Template, turn by turn in order of ``turn``:

    user        [INST]text[/INST]
    assistant   text</s>
    system      <<SYS>>text<</SYS>>
    any other   [ROLE]role[/ROLE]text[/ROLE]

The control strings are added to the tokenizer as special tokens, so no token holds both a
part of a text and a part of a mark.  A control string inside a text (the tokenizer's own
special tokens included) gets a backslash after its first character, and one that already
has backslashes there gets one more; taking one away again restores every text.

Conversations are gathered by ``conv_id``.  Those of over ``PART_CHARS`` characters (a
``conv_id`` that a third of the rows share, say) are instead range-sorted by turn and come
as parts, runs of whole turns; since every token ends where a mark begins, the parts of a
conversation joined are its text, its ids and its mask.  A single turn is rendered whole.

NULL roles and texts count as empty; a NULL ``turn`` comes first; rows of one turn are
ordered by the md5 of role, newline and text, and repeated rows all stay; rows of a NULL ``conv_id`` are one
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm import _common as C

START, END = "<s>", "</s>"  # the template needs no start; in texts it is escaped all the same
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("", END)}
ROLE, ROLE_END = "[ROLE]", "[/ROLE]"
CONTROLS = (START, END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", ROLE, ROLE_END)

PART_CHARS = 8 << 20  # a conversation of more characters comes in parts
SLICE = 1 << 20  # characters given to the tokenizer at once; a longer run without a space is encoded whole

FORMATTED = "part long, n_turns long, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
_CUT = re.compile(r"(?<=\S)(?=[ \n])")  # no pre-token of a byte-level tokenizer goes on here


class Escape:
    """A backslash after the first character of every control string in a text, and back."""

    def __init__(self, controls: tuple[str, ...]):
        heads = sorted({c[0] for c in controls})
        ahead = [(re.escape(h), "|".join(re.escape(c[1:]) for c in controls if c[0] == h)) for h in heads]
        self.into = re.compile("|".join(rf"{h}(?=\\*(?:{tails}))" for h, tails in ahead))
        self.back = re.compile("|".join(rf"{h}\\(?=\\*(?:{tails}))" for h, tails in ahead))

    def escape(self, text: str) -> str:
        return self.into.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self.back.sub(lambda m: m[0][0], text)


_loaded: dict[str, tuple] = {}


def tokenizer(path: str):
    """The worker's tokenizer, with the control strings as special tokens after its own ids, and the escape for both."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        tok = Tokenizer.from_file(path)
        own = tuple(t.content for t in tok.get_added_tokens_decoder().values())
        tok.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROLS])
        _loaded[path] = tok, Escape(CONTROLS + own)
    return _loaded[path]


def render(turns: list[tuple[str, str]], escape: Escape) -> tuple[str, np.ndarray]:
    """The text of (role, text) turns and the sorted character spans of the assistants' texts."""
    out, spans, size = [], [], 0
    for role, text in turns:
        text = escape.escape(text)
        before, after = MARKS[role] if role in MARKS else (ROLE + escape.escape(role) + ROLE_END, ROLE_END)
        if role == "assistant":
            spans.append((size, size + len(text)))
        out += before, text, after
        size += len(before) + len(text) + len(after)
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def parse(text: str, escape: Escape) -> list[tuple[str, str]]:
    """The turns of a rendered text (or of a part of one)."""
    at, out = 0, []
    while at < len(text):
        role, (before, after) = "assistant", MARKS["assistant"]
        for name in ("user", "system"):
            if text.startswith(MARKS[name][0], at):
                role, (before, after) = name, MARKS[name]
        if text.startswith(ROLE, at):
            stop = text.index(ROLE_END, at)
            role, before, after = escape.unescape(text[at + len(ROLE): stop]), text[at: stop + len(ROLE_END)], ROLE_END
        at += len(before)
        stop = text.index(after, at)
        out.append((role, escape.unescape(text[at: stop])))
        at = stop + len(after)
    return out


def pieces(text: str, size: int = SLICE) -> list[tuple[int, str]]:
    """A text cut before white space into runs of about ``size`` characters, with their places."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        out.append((at, text[at: cut.start()]))
        at = cut.start()
    return [*out, (at, text[at:])]


def encode(tok, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids, and start and end characters, of the tokens of each text."""
    runs = [(i, at, piece) for i, text in enumerate(texts) for at, piece in pieces(text)]
    out: list[tuple[list, list]] = [([], []) for _ in texts]
    for (i, at, _), got in zip(runs, tok.encode_batch([r[2] for r in runs], add_special_tokens=False)):
        out[i][0].append(np.array(got.ids, np.int32))
        out[i][1].append(np.array(got.offsets, np.int32).reshape(-1, 2) + np.int32(at))
    return [(np.concatenate(ids), np.concatenate(offsets)) for ids, offsets in out]


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The tokens that share a character with a span; tokens and spans are sorted, and no two spans overlap."""
    spans = spans[spans[:, 1] > spans[:, 0]]
    first = np.searchsorted(offsets[:, 1], spans[:, 0], "right")
    last = np.searchsorted(offsets[:, 0], spans[:, 1], "left")
    step = np.zeros(len(offsets) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    return np.cumsum(step[:-1]) > 0


def formatted(path: str, part_chars: int):
    """The task that turns sorted (conv_id, role, text) rows into rendered, encoded and masked rows."""
    def run(batches):
        tok, escape = tokenizer(path)
        task, seq, held, turns, key, size, waiting = TaskContext.get().partitionId(), 0, [], [], None, 0, 0

        def flush():
            texts, spans = zip(*(render(t, escape) for _, t in held))
            coded = encode(tok, list(texts))
            masks = [loss_mask(offsets, s) for (_, offsets), s in zip(coded, spans)]
            ends = pa.array(np.cumsum([0, *map(len, masks)]).astype(np.int32))
            places = np.concatenate([offsets for _, offsets in coded])
            lists = np.concatenate([ids for ids, _ in coded]), places[:, 0], places[:, 1], np.concatenate(masks)
            return pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in held], id_type), pa.array((task << 32) + seq + np.arange(len(held))), pa.array([len(t) for _, t in held], pa.int64()),
                pa.array(texts, pa.string()), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists)],
                names=["conv_id", "part", "n_turns", "text", "ids", "starts", "ends", "loss"])

        for batch in batches:
            id_type = batch.column(0).type
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if turns and (conv != key or size > part_chars):
                    held.append((key, turns))
                    turns, size = [], 0
                    if waiting > SLICE:
                        yield flush()
                        held, seq, waiting = [], seq + len(held), 0
                key = conv
                turns.append((role, text))
                size += len(text) + len(role)
                waiting += len(text) + len(role)
        if turns:
            held.append((key, turns))
            yield flush()

    return run


def format_chats(conversations: DataFrame, tokenizer_path: str, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, n_turns, text, ids, starts, ends, loss: one row per conversation, or per part of a long one."""
    shape = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, {FORMATTED}"
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.md5(F.concat_ws("\n", "role", "text")))
    chars = rows.groupBy("conv_id").agg(F.sum(F.length("text").cast("long") + F.length("role")).alias("chars"))
    long = C.materialize(chars.where(F.col("chars") > part_chars).select(F.col("conv_id").alias("long_id")), "long-conversations")
    order = ["conv_id", "turn", "tie"]

    def whole(turns: DataFrame) -> DataFrame:
        placed = turns.repartition("conv_id").sortWithinPartitions(*order)
        return placed.select("conv_id", "role", "text").mapInArrow(formatted(tokenizer_path, part_chars), shape).withColumn("part", F.lit(0).cast("long"))

    if not long.limit(1).count():
        return whole(rows)
    meets = F.col("conv_id").eqNullSafe(F.col("long_id"))
    # a long conversation is spread by range, and equal rows (of one place in its order) by a number of their own
    cut = C.materialize(rows.join(long, meets, "left_semi").withColumn("twin", F.monotonically_increasing_id()), "long-turns")
    parts = cut.repartitionByRange(*order, "twin").sortWithinPartitions(*order, "twin")
    return whole(rows.join(long, meets, "left_anti")).unionByName(parts.select("conv_id", "role", "text").mapInArrow(formatted(tokenizer_path, part_chars), shape))


def read_chats(chats: DataFrame, tokenizer_path: str) -> DataFrame:
    """What formatted conversations say: per conversation its turns and its text under the mask, digested.

    A conversation's parts are read in their order.  SHA-256 runs through a conversation
    from its start to its end, so one task reads it, a part at a time.
    """
    def run(batches):
        _, escape = tokenizer(tokenizer_path)
        key, state = None, None

        def row():
            turns, spoken = state[1], state[3]
            return [key, state[0], turns.hexdigest(), state[2], spoken.hexdigest(), state[4]]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kinds, done = [batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], []
            for i in range(batch.num_rows):
                conv, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                starts, ends, loss = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (2, 3, 4))
                if state is None or conv != key:
                    if state:
                        done.append(row())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text, escape):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                # runs of masked tokens, each from its first token's start to its last one's end
                edge = np.flatnonzero(np.diff(np.concatenate(([False], loss, [False])).astype(np.int8)))
                for a, b in zip(edge[::2], edge[1::2]):
                    said = escape.unescape(text[starts[a]: ends[b - 1]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if done:
                yield out(done)
        if state:
            yield out([row()])

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digest(chats: DataFrame, tokenizer_path: str) -> DataFrame:
    """``read_chats`` of written chats, parts of a conversation brought together in their order."""
    placed = chats.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return read_chats(placed.select("conv_id", "text", "starts", "ends", "loss"), tokenizer_path)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, said = public_tokenizers.path("byte_bpe_50k.json"), "</s>[INST] ok [/INST]"
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = C.materialize(format_chats(rows.unionByName(planted), path), "chats")
    return digest(chats, path)


def _escaped(text: str) -> str:
    """SQL of an escaped text."""
    return (rf"regexp_replace(regexp_replace({text}, '(<)(\\*)(s>|/s>|<SYS>>|</SYS>>|\|endoftext\|>)', '\1\\\2\3', 'g'), "
            rf"'(\[)(\\*)(INST\]|/INST\]|ROLE\]|/ROLE\])', '\1\\\2\3', 'g')")


ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length({_escaped("said")}) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 4 ELSE 20 + length({_escaped("role")}) END AS chars FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn NULLS FIRST, md5(role || chr(10) || said)) AS turns,
    coalesce(string_agg(said, '' ORDER BY turn NULLS FIRST, md5(role || chr(10) || said)) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
