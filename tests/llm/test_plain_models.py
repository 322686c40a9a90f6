"""Plain versions of the learned operators: statistics, features, tree walks and FTRL, one row and one number at a time."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableprep.llm import doc_stats, quality, quality_rules, secrets, toxicity

from ..conftest import SF001
from .test_models import base, brute_slots

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_features(text):
    """The 19 numbers of a text, from its characters, words and lines."""
    text = text or ""
    raw, words, lines = text.encode(), WORDS.findall(text), text.split("\n")
    n_words, word_chars, symbols, dup, repeat = base(text)
    size, w, ln = max(1, len(raw)), max(1, n_words), max(1, len(lines))
    count = lambda test: sum(map(test, map(chr, raw)))
    asc = lambda c: ord(c) < 128
    return [math.log1p(len(raw)), math.log1p(n_words), word_chars / w, count(lambda c: asc(c) and c.isupper()) / size, count(lambda c: asc(c) and c.islower()) / size,
            count(lambda c: c in "0123456789") / size, count(lambda c: 32 < ord(c) < 127 and not c.isalnum()) / size, count(lambda c: not asc(c)) / size,
            symbols / max(1, word_chars), text.count("|") / w, (text.count("!") + text.count("?")) / w, sum(text.count(c) for c in ".,;:") / w,
            n_words / ln if raw else 0, dup / ln, sum(not WORDS.search(x) for x in lines) / ln if raw else 0, repeat / w, len(set(words)) / w,
            sum(len(x.encode()) > 20 for x in words) / w, sum(x.encode().isupper() for x in words) / w]


def walk(model, row):
    """A forest's trees for one row, node by node."""
    for node in model.roots:
        while model.left[node] != node:
            node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
        yield model.value[node]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB1é#|!?.,;\n\t _-Z"), max_size=60), st.text(max_size=30)), min_size=1, max_size=5))
def test_statistics(texts):
    got = doc_stats.features(doc_stats.measure(pa.array(texts, pa.string())))
    assert np.allclose(got, [plain_features(t) for t in texts])


def test_quality_scores_by_plain_walks(spark, odd_docs, docs):
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    rows = odd_docs.select("doc_id", "text").union(docs.select("doc_id", "text").limit(150))
    got = Counter((str(r.doc_id), round(r.score, 9)) for r in quality.score_documents(rows, model).collect())
    want = Counter((str(r.doc_id), round(1 / (1 + math.exp(-(model.base + sum(walk(model, plain_features(r.text)))))), 9)) for r in rows.collect())
    assert got == want


def test_rule_verdicts_by_plain_walks(spark, odd_docs, docs):
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    model = quality_rules.fit_rules(docs, labels)
    rows = docs.select("doc_id", "text").limit(200)
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    for r in rows.collect():
        n, _, _, _, repeat = base(r.text)
        failed = n < 50 or 100 * repeat > 50 * n
        score = model.base + sum(walk(model, plain_features(r.text)))
        assert got[r.doc_id] == (not failed and score >= 0)


def plain_ftrl(rows, epochs):
    """FTRL-proximal with dictionaries."""
    z, n = Counter(), Counter()

    def weight(i):
        lean, l2 = (0.0, 0.0) if i == toxicity.BIAS else (toxicity.L1, toxicity.L2)
        if abs(z[i]) <= lean:
            return 0.0
        return (math.copysign(lean, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + l2)

    for _ in range(epochs):
        for slots, y in rows:
            every = [*slots, toxicity.BIAS]
            w = [weight(i) for i in every]
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w))))) - y
            for i, x in zip(every, w):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * x
                n[i] += g * g
    return {i: weight(i) for i in n if weight(i)}


@pytest.mark.parametrize("seed", range(4))
def test_ftrl_against_dictionaries(seed):
    rng = np.random.default_rng(seed)
    rows = [(np.unique(rng.integers(0, 60, rng.integers(0, 30))) * 17_001, float(rng.random() < 0.4)) for _ in range(300)]
    rows = [(np.append(s, 5) if y else s, y) for s, y in rows]
    slot, w = toxicity.learn(rows, 3)
    want = plain_ftrl([(s.tolist(), y) for s, y in rows], 3)
    assert want and set(slot.tolist()) == set(want) and np.allclose(w, [want[i] for i in slot.tolist()])


def test_toxicity_scores_by_plain_sums(spark, odd_docs, docs):
    model = toxicity.fit(docs, spark.read.parquet(f"{SF001}/labels.parquet"))
    weight = dict(zip(model[0].tolist(), model[1].tolist()))
    rows = odd_docs.select("doc_id", "text").where("doc_id IS NULL OR doc_id <> 4").union(docs.select("doc_id", "text").limit(60))
    got = sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.score_documents(rows, model).collect())
    score = lambda t: 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(weight.get(s, 0.0) for s in brute_slots(t)) + weight.get(toxicity.BIAS, 0.0)))))
    assert got == sorted((str(r.doc_id), round(score(r.text), 9)) for r in rows.collect())


def plain_traits(row, words, pairs, shares):
    """The features of one finding."""
    value = row["value"]
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    n, low, at, inside = len(value), value.lower(), 0, 0
    while at < len(low):
        best = max((len(w) for w in words if low.startswith(w, at)), default=0)
        inside, at = inside + best, at + (best or 1)
    surprise = [-math.log2(pairs[a, b] / sum(pairs[a, c] for c in "abcdefghijklmnopqrstuvwxyz")) for a, b in zip(low, low[1:]) if "a" <= a <= "z" and "a" <= b <= "z"]
    return [n, *(kinds.count(k) / n for k in "duls"), sum(a != b for a, b in zip(kinds, kinds[1:])) / n, float(all(c in "0123456789abcdefABCDEF" for c in value)),
            len(set(value)) / n, sum(surprise) / len(surprise) if surprise else 0.0, inside / len(low), sum(c in "aeiouAEIOU" for c in value) / n,
            float(row["in_path"] or "/" in value), float(row["extension"]), float(row["assigned"]), float(row["quoted"]),
            *(shares[k].get(str(row[k]), shares[k][""]) for k in ("before", "after", "path"))]


def test_secret_scores_by_plain_features_and_walks(spark, docs):
    """Dictionary, neighbour shares, features and forest of op1, each from its definition."""
    found = secrets.findings(docs).persist()
    labels = secrets.rule_labels(found)
    judge = secrets.train(docs, found, labels)
    counted = Counter(w for r in docs.select("text").collect() for w in re.findall(r"[a-z]{3,}", re.sub(r"[A-Z]", lambda m: m[0].lower(), r.text or "")))
    top = dict(sorted(counted.items(), key=lambda p: (-p[1], p[0]))[: secrets.WORDS])
    assert judge.book.words == set(top)
    pairs = Counter({(a, b): 1 for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"})
    for w, n in top.items():
        for p in zip(w, w[1:]):
            pairs[p] += n
    taught = {(r["doc_id"], r["start"]): r["label"] for r in labels.collect()}
    rows = [r.asDict() for r in found.collect()]
    train = [(r, taught[r["doc_id"], r["start"]]) for r in rows if (r["doc_id"], r["start"]) in taught]
    share = (sum(y for _, y in train) + 0.5) / (len(train) + 1)
    shares = {}
    for k in ("before", "after", "path"):
        every, good = Counter(str(r[k]) for r, _ in train), Counter()
        for r, y in train:
            good[str(r[k])] += y
        shares[k] = {w: (good[w] + 2 * share) / (n + 2) for w, n in every.items() if n >= 5} | {"": share}
    some = rows[:: max(1, len(rows) // 120)]
    x = [plain_traits(r, set(top), pairs, shares) for r in some]
    assert np.allclose([secrets.traits(r, judge.book, judge.shares) for r in some], x)
    leaves = [list(walk(judge.forest, row)) for row in x]
    assert np.allclose(judge.scores(some), [sum(v) / len(v) for v in leaves])
