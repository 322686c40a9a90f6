import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tableprep.llm import mixing, quality, secrets

from ..conftest import SF001, SF0001
from .conftest import DOCS
from .test_simhash import brute_components, brute_fingerprint
from .test_tokens_packing import check_packing

SECRET = re.compile(r"AKIA[A-Z0-9]{16}|(?<=token = \")[0-9a-f]{40}|(?<=password=)[0-9a-f]{12,}")


def test_op1_finds_the_known_secrets(spark, docs):
    """Against a plain scan: every candidate is reported once, known secrets are called so and card numbers aren't."""
    got = {(r.doc_id, r.start): r for r in secrets.op1_secret_scan(spark, SF001).collect()}
    rows = docs.collect()
    want = {(r.doc_id, m.start()): m.group() for r in rows for m in re.finditer(r"[A-Za-z0-9+/_\-]{12,}={0,2}", r.text or "", re.ASCII) if secrets.likely(m.group().encode())}
    assert got.keys() == want.keys()
    for at, value in want.items():
        assert (got[at].length, got[at].sha256) == (len(value), hashlib.sha256(value.encode()).hexdigest())
        assert got[at].is_secret == (got[at].score >= secrets.THRESHOLD)
    true = {(r.doc_id, m.start()) for r in rows for m in SECRET.finditer(r.text or "")}
    assert true and all(got[at].is_secret for at in true & got.keys())
    assert not any(got[at].is_secret for at, value in want.items() if value.isdigit())


def test_labelled_findings_teach_the_forest(spark):
    """Labels given: hex after `sha` is no secret, hex after `secret` is; judged on documents without labels."""
    def text(i):
        return f"some words here {('sha', 'secret')[i % 2]}: {hashlib.sha1(str(i).encode()).hexdigest()} and more words"

    df = spark.createDataFrame([(i, text(i), None, f"src{i % 3}", None) for i in range(300)], DOCS)
    labels = spark.createDataFrame([(i, text(i).index(": ") + 2, float(i % 2)) for i in range(200)], "doc_id long, start long, label double")
    got = secrets.scan(df, labels).collect()
    assert len(got) == 300 and all(r.is_secret == bool(r.doc_id % 2) for r in got if r.doc_id >= 200)
    masked = {r.doc_id: r.text for r in secrets.redact(df, labels).collect()}
    assert all((secrets.MASK in masked[i]) == bool(i % 2) and masked[i].endswith(" and more words") for i in range(300))


PLANTED = ['password = "{}"', "password={}", 'api_key: "{}"', "secret = '{}'", "passwd: {}", '{{"token": "{}", "n": 1}}', "postgres://admin:{}@db.host/prod"]
SHORT = ["hunter{}!", "Tr0ub4dor&{}", "abcd{}efg", "9f8e7d{}", "P@ssw0rd!{}xx", "grüße{}", "x{}"]
LETTERS = ["QmZxTrLpWsKd", "correct", "abcdefghijklmnopqrstuvwxy", "p@ss-word!"]


def test_short_punctuated_and_letter_only_secrets(spark):
    """What stands after a credential's name or as a URL's password is a candidate as a whole, called a secret and masked."""
    made, texts = {}, {}
    for i in range(420):
        value = LETTERS[i % 4] if i % 5 == 0 else SHORT[i % 7].format(i)
        head = f"some words here, order {10**13 + i} of "
        line = PLANTED[i // 7 % 7].format(value)
        texts[i] = f"{head}{line} and more words"
        made[(i, len(head) + line.rindex(value))] = value
    df = spark.createDataFrame([(i, t, None, "src", None) for i, t in texts.items()], DOCS)
    got = {(r.doc_id, r.start): r for r in secrets.scan(df).collect()}
    true = {(i, a) for (i, a), value in made.items()}
    assert true <= got.keys()
    for at in true:
        assert (got[at].length, got[at].sha256) == (len(made[at]), hashlib.sha256(made[at].encode()).hexdigest())
        assert got[at].is_secret
    assert len(got) == 840 and not any(r.is_secret for at, r in got.items() if at not in true)
    masked = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    for (i, a), value in made.items():
        assert masked[i] == texts[i][:a] + secrets.MASK + texts[i][a + len(value):]


def test_overlapping_candidates_and_bounds_of_values():
    found = lambda t: [v[2] for v in secrets.find(t.encode())]
    assert found('secret = "user password=hunter2" z') == ["user password=hunter2", "hunter2"]
    assert found("?key=1a&password=hunter2 x") == ["1a&", "hunter2"]
    assert found('{"token":123456,"user":"bob"}') == ["123456"]
    assert found('password="" monkey: 5 tokens=3 key::x token = key: ') == found('http://host:80/a@b') == []
    assert found("abcdefghijklmnopqrstuvwxy") == ["abcdefghijklmnopqrstuvwxy"]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    extra = odd_docs.selectExpr("*", "'v' AS value", "true AS is_secret", "1 AS start")
    assert secrets.scan(extra).collect() == []
    assert sorted(map(str, secrets.redact(odd_docs).collect())) == sorted(map(str, rows))
    assert secrets.scan(no_docs).collect() == [] and secrets.redact(no_docs).collect() == []


def plain_stage(name, before, after, spark, sf):
    """What a stage must have done, told by a version without Spark."""
    if name == "quality":
        verdict = {r.doc_id: r.predicted for r in quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
        assert sorted(after) == sorted(r for r in before if verdict[r.doc_id])
    elif name == "near_duplicates":
        rows = sorted(before, key=lambda r: r.doc_id)
        roots = brute_components([brute_fingerprint(r.text) for r in rows])
        assert sorted(after) == sorted({k: rows[k] for k in roots}.values())
    elif name == "secrets":
        was = {r.doc_id: r for r in before}
        assert Counter(list(was)) == Counter(r.doc_id for r in after)
        for r in after:
            assert not SECRET.search(r.text)
            if not any(secrets.likely(m.encode()) for m in re.findall(r"[A-Za-z0-9+/_\-]{12,}", was[r.doc_id].text)):
                assert r == was[r.doc_id]
            assert r.n_chars == len(r.text)
    elif name == "mixing":
        size = lambda t: len((t or "").encode().split())
        was, taken, source = {r.doc_id: r for r in before}, defaultdict(int), defaultdict(int)
        for r in after:
            assert was[r.doc_id].text.startswith(r.text) and r.source == was[r.doc_id].source
            taken[r.doc_id] += size(r.text)
            source[r.source] += size(r.text)
        assert all(n <= 2 * size(was[i].text) for i, n in taken.items())
        target = {r.source: r.target for r in mixing.mix_plan(spark.createDataFrame(before)).collect()}
        assert all(abs(source[s] - t) <= 0.5 for s, t in target.items())
    else:
        tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        check_packing(after, [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in before], 2048)


@pytest.mark.parametrize("sf", [SF0001, SF001])
def test_every_stage_against_a_plain_version(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns or k == 4
        after = docs.collect()
        plain_stage(name, before, after, spark, sf)
        before = after
    if sf == SF0001:  # run() is the chain of the stages
        cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
        again = __spark_entry__.queries()["pipeline"](spark, sf).select(cols).collect()
        assert sorted(again) == sorted(docs.select(cols).collect())


def test_pipeline_stages_take_odd_and_no_documents(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd_docs, SF0001)
        assert name == "packing" or got.columns == odd_docs.columns
        got.collect()
        assert stage(spark, no_docs, SF0001).collect() == []
