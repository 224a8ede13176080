"""Secret scans: base spans against Python's patterns, added spans on planted strings."""

import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from launchlens.llm import queries, secret_scan as S

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    """Base spans of a text in code points."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def expected(text):
    spans = base(text or "")
    kinds = ("assign", "access", "hex")
    written = ",".join(f"{kinds[k]}:{a}:{e}" for a, k, e in spans)
    return (*(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(written.encode()).hexdigest(), written)


def token(rng, n, letters=string.ascii_letters + string.digits):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    h = token(rng, 40, "0123456789abcdef")
    rows = [
        (1, f"é PassWord = '{token(rng, 12)}' ü token:{h} secret='short'"), (2, f"{h}AKIA{token(rng, 12, string.ascii_uppercase)} AKIASHORT {h}{h}g{h[:31]}"),
        (3, f'api_key": "{h}", apikey={token(rng, 9)}. toKen=abcdefghij ſecret=abcdefghij'), (3, "token=abcdefghijk"), (3, "token=abcdefghijk"),
        (None, f"passwd={h} 日本 {h}"), (4, ""), (5, None), (6, "token token=" + "x" * 50_000), (7, "secret" * 5000 + " " * 5000),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string")


def digests(docs):
    return S.span_digests(S.find_secrets(docs))


def test_base_spans(spark, odd, edge, no_docs):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").union(odd).union(edge.select("doc_id", "text"))
    got = sorted(repr((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)) for r in digests(docs).collect())
    assert got == sorted(repr((r.doc_id, *expected(r.text)[:4])) for r in docs.collect())
    assert digests(no_docs).collect() == []


def test_spans_hold_the_base_and_only_more(spark, odd):
    texts = {r.doc_id: r.text for r in odd.where("doc_id in (1, 2)").collect()}
    for r in digests(odd).where("doc_id in (1, 2)").collect():
        assert set(expected(texts[r.doc_id])[4].split(",")) <= set(r.spans.split(","))
        places = [int(s.split(":")[1]) for s in r.spans.split(",")]
        assert places == sorted(places)


def test_planted_strings_are_found_and_words_left_alone(spark):
    rng = random.Random(9)
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    plain = ["HttpServletRequestWrapper", "max_retry_backoff_seconds", "usr/local/share/applications", "4111111111111111", "Donaudampfschifffahrt", "2024-11-03T10-22-59"]
    planted = [token(rng, n) for n in (24, 28, 32, 40)] + [token(rng, 30, string.ascii_letters + string.digits + "+/") for _ in range(3)] + [token(rng, 24, string.ascii_uppercase + "234567")]
    rows = [(10_000 + i, f"die Antwort é lautet {s} und mehr") for i, s in enumerate(planted + plain)]
    found = S.find_secrets(docs.union(spark.createDataFrame(rows, docs.schema)))
    out = found.select("_keys.doc_id", F.explode("added").alias("s")).select("doc_id", "s.*").collect()
    texts = dict(rows)
    hit = {texts[r.doc_id][r.start : r.end] for r in out if r.doc_id >= 10_000}
    assert hit == set(planted)
    assert {r.kind for r in out} == {S.MODEL_KIND} and not [r for r in out if r.doc_id < 10_000]


def test_own_samples(spark):
    rng = random.Random(1)
    words = ["connection", "settings", "handler", "request", "response", "printer", "station"]
    samples = [("_".join(rng.sample(words, 3)), False) for _ in range(300)] + [(token(rng, 32), True) for _ in range(300)] + [(None, True), ("x", None)]
    docs = spark.createDataFrame([(1, f"{token(rng, 32)} request_handler_settings", 3)], "doc_id long, text string, base int")
    row = S.find_secrets(docs, spark.createDataFrame(samples, "sample string, secret boolean"), keys=("doc_id", "base")).first()
    assert [(s.start, s.end) for s in row.added] == [(0, 32)] and row["_keys"].base == 3


def test_held_out_samples_are_told_apart(spark):
    rng = random.Random(7)
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    models = S.fit(S.labelled_counts(docs.where("doc_id % 2 = 0")))
    words = [w for r in docs.where("doc_id % 2 = 1").collect() for w in re.findall(r"[A-Za-z]{16,}", r.text or "")]
    strings = [token(rng, 24) for _ in range(500)]
    def judged(tokens):
        return [bool(added) for _, added in S.block_spans([t.encode() for t in tokens], models)]
    assert sum(judged(strings)) >= 495 and sum(judged(words)) <= len(words) // 1000
