"""Secret scans: candidate strings, judged by a random forest that takes out the false positives.

A candidate is a run of 12 or more characters of keys and digests that holds a digit, has a
capital after its first character or 20 letters on end; the whole value, of any length and
characters, assigned to a credential's name (what stands in the quotes, else up to white
space or the next such assignment); or the password part of a URL, which counts as assigned
to the name ``password``.  A value stands for a run that starts where it starts; other
candidates may overlap.  Its features: length, character kinds, character transitions
(between kinds, and how usual its letter pairs are in the dictionary's words), dictionary
coverage, the path it stands in (in the text, and the path or source of the document) and
its neighbouring words.  The dictionary is made of the most frequent short words of all
documents (``words`` of them at most); the neighbours' and paths' weights are the shares
of true findings in the training rows.

Training rows are labelled findings (doc_id, start, label), at most ``max_rows`` of them,
those of the least md5 of their place.  The tables at hold have none, so the queries derive them by
rule (``rule_labels``): known shapes and assignments to a credential's name that hold a
digit are true, plain numbers (after a credential's name, those under four digits) and plain
words after no such name are false, anything else is left for the forest to judge.

NULL text holds no candidate; a NULL doc_id or path is a value of its own; repeated rows
are judged each; texts are scanned whole; without any labelled finding nothing is called a
secret; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.functions.hashing import hash_hex
from tableprep.llm import _common as C
from tableprep.llm import trees
from tableprep.llm.quality import held_out

MAX_ROWS, WORDS, THRESHOLD, CONTEXT = 12_000, 4_000, 0.5, 40
MASK = "[SECRET]"

_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_\-]{12,}={0,2}")
_WORD = re.compile(rb"[A-Za-z]+")
_LETTERS = bytes(b if 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))  # small letters, anything else a space
_KEY_ID = re.compile(r"AKIA[A-Z0-9]{16}")
_NAMES = frozenset(("token", "password", "passwd", "secret", "key", "apikey", "credential", "auth", "bearer"))
_ASSIGNED = re.compile(rf"(?i)(?<![a-z])({'|'.join(sorted(_NAMES))})[0-9_]*[\"']?\]?[ \t]*(?:=>|:=|=+|:(?!:))[ \t]*".encode())
_QUOTED = re.compile(rb"""\"([^\"\\\r\n]*(?:\\.[^\"\\\r\n]*)*)\"|'([^'\\\r\n]*(?:\\.[^'\\\r\n]*)*)'""")
_BARE = re.compile(rb"""(?:\"{3}|'{3}|[\"'])?(?![\"'])((?:(?!,[\"'])\S)+)""")
_URL = re.compile(rb"://[^\s/:@]*:([^\s/]+)@")
FEATURES = ["length", "digits", "uppers", "lowers", "symbols", "kind_changes", "hex_only", "distinct", "pair_surprise", "dictionary", "vowels",
            "in_path", "extension", "assigned", "quoted", "before_share", "after_share", "path_share"]
FOUND = "path string, start long, length long, value string, before string, after string, assigned boolean, quoted boolean, in_path boolean, extension boolean"


def likely(run: bytes) -> bool:
    """Whether a run may be a secret at all."""
    if any(48 <= b <= 57 for b in run):
        return True
    return run[1:] != run[1:].lower() or any(len(w) >= 20 for w in _WORD.findall(run))


def values(raw: bytes) -> dict[int, tuple[int, str, bool]]:
    """First byte -> (end, name assigned to, quoted) of every value assigned to a credential's name, and of every password in a URL."""
    out = {m.start(1): (m.end(1), "password", False) for m in _URL.finditer(raw)}
    names, closed = list(_ASSIGNED.finditer(raw)), 0
    for m, following in zip(names, [*names[1:], None]):
        name, at = m.group(1).decode().lower(), m.end()
        whole = _QUOTED.match(raw, at)
        if whole and whole.end() - at > 2:
            closed = max(closed, whole.end() - 1)
            out[at + 1] = (whole.end() - 1, name, True)
            continue
        # a bare value ends before the next name, and inside the quotes it stands in
        stop = following.start() if following else len(raw)
        bare = _BARE.match(raw, at, min(stop, closed) if at < closed else stop)
        if bare:
            out[bare.start(1)] = (bare.end(1), name, False)
    return out


def find(raw: bytes) -> list[tuple]:
    """(first byte, end, value, word before, word after, assigned, quoted, in a path, has an extension) of each candidate, by first byte."""
    spans = values(raw)
    for m in _CANDIDATE.finditer(raw):
        if likely(m.group()):
            end, name, quoted = spans.get(m.start(), (0, None, False))
            spans[m.start()] = (max(end, m.end()), name, quoted)
    out = []
    for a, (b, name, whole) in sorted(spans.items()):
        left, right = raw[max(0, a - CONTEXT): a], raw[b: b + CONTEXT]
        before, after = _WORD.findall(left), _WORD.search(right)
        bare = left.rstrip(b" \"'")
        out.append((a, b, raw[a:b].decode(), name or (before[-1].decode().lower() if before else ""), after.group().decode().lower() if after else "",
                    name is not None or bare.endswith((b"=", b":")), whole or (left[-1:] in (b'"', b"'") and right[:1] in (b'"', b"'")),
                    left[-1:] in (b"/", b"\\", b"."), right[:1] == b"." and right[1:2].isalpha()))
    return out


class Dictionary:
    """Frequent words and the surprise of their letter pairs."""

    def __init__(self, counts: dict[str, int]):
        self.words, pairs = set(counts), np.ones((26, 26))
        self.sizes = sorted({len(w) for w in counts}, reverse=True)
        for word, n in counts.items():
            for x, y in zip(word, word[1:]):
                pairs[ord(x) - 97, ord(y) - 97] += n
        self.surprise = -np.log2(pairs / pairs.sum(1, keepdims=True))

    def coverage(self, value: str) -> float:
        """Share of the characters inside dictionary words, longest word first from the left."""
        text, i, inside = value.lower(), 0, 0
        while i < len(text):
            size = next((k for k in self.sizes if i + k <= len(text) and text[i: i + k] in self.words), 0)
            inside += size
            i += size or 1
        return inside / max(1, len(text))

    def pairs(self, value: str) -> float:
        text = value.lower()
        found = [self.surprise[ord(x) - 97, ord(y) - 97] for x, y in zip(text, text[1:]) if "a" <= x <= "z" and "a" <= y <= "z"]
        return float(np.mean(found)) if found else 0.0


def kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def traits(row, book: Dictionary, shares: dict[str, dict[str, float]]) -> list[float]:
    """The features of one finding (a row of FOUND)."""
    value = row["value"]
    kinds = [kind(c) for c in value]
    n, many = len(value), Counter(kinds)
    return [n, many[0] / n, many[1] / n, many[2] / n, many[3] / n, sum(a != b for a, b in zip(kinds, kinds[1:])) / n, all(c in "0123456789abcdefABCDEF" for c in value),
            len(set(value)) / n, book.pairs(value), book.coverage(value), sum(c in "aeiouAEIOU" for c in value) / n, row["in_path"] or "/" in value, row["extension"],
            row["assigned"], row["quoted"], *(shares[k].get(str(row[k]), shares[k][""]) for k in ("before", "after", "path"))]


def findings(docs: DataFrame, path_col: str = "source") -> DataFrame:
    """All candidates of all documents, with what the features need."""
    def run(batches):
        for batch in batches:
            data, off = C.utf8_batch(batch.column(2))
            rows, at = [], []
            for i, (path, a, b) in enumerate(zip(batch.column(1).to_pylist(), off[:-1].tolist(), off[1:].tolist())):
                raw = data[a:b].tobytes()
                for s, e, *rest in find(raw):
                    value, before, after, assigned, quoted, in_path, extension = rest
                    rows.append({"path": path, "start": len(raw[:s].decode()), "length": len(value), "value": value, "before": before, "after": after,
                                 "assigned": assigned, "quoted": quoted, "in_path": in_path, "extension": extension})
                    at.append(i)
            found = pa.RecordBatch.from_pylist(rows, schema=schema)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *found.columns], names=["doc_id", *schema.names])

    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), *((c, pa.string()) for c in ("value", "before", "after")),
                        *((c, pa.bool_()) for c in ("assigned", "quoted", "in_path", "extension"))])
    path = C.quoted(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    kind_ = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", path.alias("path"), "text").mapInArrow(run, f"doc_id {kind_}, {FOUND}")


def dictionary(docs: DataFrame, words: int = WORDS) -> Dictionary:
    """The most frequent runs of 3 letters or more (capitals as small ones), counted over all documents; each task sums its own first."""
    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            data, off = C.utf8_batch(batch.column(0))
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                total.update(data[a:b].tobytes().translate(_LETTERS).split())
            if len(total) > 1 << 18:
                yield short(total)
                total.clear()
        yield short(total)

    def short(total):
        kept = [(w.decode(), n) for w, n in total.items() if len(w) >= 3]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Dictionary({r.word: r.n for r in counts.orderBy(F.desc("n"), "word").limit(words).collect()})


def rule_labels(found: DataFrame) -> DataFrame:
    """Labelled findings by rule, of the documents that are not held out."""
    digit = F.col("value").rlike("[0-9]")
    named = F.col("assigned") & F.col("before").isin(*sorted(_NAMES))
    # after a name, short numbers are counts and anything without a digit may be a password
    true = F.col("value").rlike(f"^{_KEY_ID.pattern}$") | (named & digit & ~F.col("value").rlike("^[0-9-]{1,11}$"))
    false = F.col("value").rlike("^[0-9-]{1,3}$") | (~named & F.col("value").rlike("^([0-9-]+|[A-Za-z-]+)$"))
    label = F.when(true, 1.0).when(false, 0.0)
    return found.where(~held_out("doc_id", 4, 2)).select("doc_id", "start", label.alias("label")).where("label IS NOT NULL")


class Judge:
    """Dictionary, neighbour shares and forest, as trained."""

    def __init__(self, rows: list, book: Dictionary):
        rows = sorted(rows, key=lambda r: (str(r["doc_id"]), r["start"], r["value"]))
        y = np.array([r["label"] for r in rows], float)
        self.book, self.shares = book, {}
        for k in ("before", "after", "path"):
            good, every = Counter(), Counter()
            for r, v in zip(rows, y):
                good[str(r[k])] += v
                every[str(r[k])] += 1
            # shares shrink to the overall one; words seen fewer than five times count as unknown
            whole = (y.sum() + 0.5) / (len(y) + 1)
            self.shares[k] = {w: (good[w] + 2 * whole) / (n + 2) for w, n in every.items() if n >= 5} | {"": whole}
        x = np.array([traits(r, book, self.shares) for r in rows], float).reshape(-1, len(FEATURES))
        self.forest = trees.bag(x, y)

    def scores(self, rows: list) -> np.ndarray:
        return self.forest.mean(np.array([traits(r, self.book, self.shares) for r in rows], float).reshape(-1, len(FEATURES)))


def train(docs: DataFrame, found: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Judge:
    """``found``: findings of ``docs`` (materialised); ``labels``: doc_id, start, label."""
    # one label for each place, the greater where they differ
    chosen = labels.groupBy("doc_id", "start").agg(F.max("label").alias("label")).orderBy(hash_hex(["doc_id", "start"]), "doc_id", "start").limit(max_rows)
    chosen = chosen.withColumnsRenamed({"doc_id": "of", "start": "at"})
    # the labels are bounded by max_rows; a NULL id is a value of its own.  Where a place holds
    # several findings (an id that stands for many texts), equal ones count once and a
    # distributed top-k keeps max_rows in all
    rows = found.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("start") == F.col("at"))).drop("of", "at")
    order = [hash_hex(["doc_id", "start"]), *(F.col(c) for c in rows.columns)]
    return Judge([r.asDict() for r in rows.distinct().orderBy(*order).limit(max_rows).collect()], dictionary(docs))


def scan(docs: DataFrame, labels: DataFrame | None = None, path_col: str = "source", max_rows: int = MAX_ROWS) -> DataFrame:
    """Every candidate: doc_id, start and length (in characters), sha256 of the string, score, is_secret."""
    found = C.materialize(findings(docs, path_col), "findings")
    judge = train(docs, found, rule_labels(found) if labels is None else labels, max_rows)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            score = judge.scores(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("start"), batch.column("length"), pa.array([hashlib.sha256(r["value"].encode()).hexdigest() for r in rows], pa.string()),
                                              pa.array(score), pa.array(score >= THRESHOLD)], names=["doc_id", "start", "length", "sha256", "score", "is_secret"])

    kind_ = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind_}, start long, length long, sha256 string, score double, is_secret boolean")


def redact(docs: DataFrame, labels: DataFrame | None = None, path_col: str = "source", max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents with every string called a secret replaced by MASK; all columns and all other text as they came."""
    found = C.materialize(findings(docs, path_col), "findings")
    judge = train(docs, found, rule_labels(found) if labels is None else labels, max_rows)
    at, mask = docs.columns.index("text"), MASK.encode()
    where = docs.columns.index(path_col) if path_col in docs.columns else None

    def run(batches):
        names = ["value", "before", "after", "assigned", "quoted", "in_path", "extension"]
        for batch in batches:
            texts = batch.column(at).to_pylist()
            paths = batch.column(where).to_pylist() if where is not None else [None] * len(texts)
            rows, spots = [], []
            for i, text in enumerate(texts):
                for a, b, *rest in find((text or "").encode()):
                    rows.append(dict(zip(names, rest)) | {"path": None if paths[i] is None else str(paths[i])})
                    spots.append((i, a, b))
            if rows:
                secret: list[list[int]] = []
                for (i, a, b), score in zip(spots, judge.scores(rows)):
                    if score >= THRESHOLD:
                        if secret and secret[-1][0] == i and a < secret[-1][2]:  # overlapping ones are masked as one
                            secret[-1][2] = max(b, secret[-1][2])
                        else:
                            secret.append([i, a, b])
                for i, a, b in reversed(secret):
                    raw = texts[i].encode()
                    texts[i] = (raw[:a] + mask + raw[b:]).decode()
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))
