"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from launchlens.llm import queries, runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(s, least, repeats):
    n, out = len(s), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            part = s[i : j + q]
            if len(part) >= max(least, repeats * q) and not any(part[d:] == part[: len(part) - d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    """The contract, word by word."""
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute(w, 6, 4)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), s, n, q, 1000 * n // q if n else None, sha("".join("%d,%d,%d\n" % r for r in found)),
        sha(" ".join(x for i, x in enumerate(w) if i not in drop)),
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(6, 4), (2, 2), (6, 3)]))
def test_maximal_runs(s, limits):
    assert [tuple(r) for r in R.maximal_runs(np.array(s, np.int64), *limits).tolist()] == brute(s, *limits)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=5), st.sampled_from([(6, 4), (6, 3), (9, 4)]))
def test_block_runs_of_several_texts(texts, limits):
    symbols = np.array([x for t in texts for x in t], np.uint64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    want, at = [], 0
    for t in texts:
        want += [(a + at, n, q) for a, n, q in brute(t, *limits)]
        at += len(t)
    got = R.block_runs(symbols, doc, *limits) if len(symbols) else np.empty((0, 3))
    assert [tuple(r) for r in got.tolist()] == want


def test_common_prefix_of_all_suffixes():
    s = [1, 2, 1, 2, 1, 1, 2, 1, 2, 1, 2, 2] * 3
    tour, step, rank = R.suffix_tree([*s, -1])
    lcp = R.CommonPrefix(tour, step)
    n = len(s)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    i, j = i[i != j], j[i != j]
    want = [next((k for k in range(n) if max(a, b) + k >= n or s[a + k] != s[b + k]), 0) for a, b in zip(i.tolist(), j.tolist())]
    assert lcp(i, j).tolist() == want
    assert np.argsort(rank).tolist() == sorted(range(n + 1), key=lambda k: [*s, -1][k:])


def test_long_period_in_a_long_text():
    rng = np.random.default_rng(5)
    part = rng.integers(1, 500, 3000).astype(np.uint64)
    s = np.concatenate([rng.integers(1, 500, 1000).astype(np.uint64), *[part] * 5, part[:17], rng.integers(500, 900, 50).astype(np.uint64)])
    got = R.block_runs(s, np.zeros(len(s), np.int64))
    assert (1000, 15_017, 3000) in {tuple(r) for r in got.tolist()}


def test_query_equals_brute_force(spark, edge, no_docs):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").where("length(text) < 6000")
    rng = random.Random(2)
    made = [(10_000 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(80)))) for i in range(200)]
    made += [(5, "x y " * 9), (5, "x y " * 9), (None, "x " * 9), (-3, "a\tb\n" * 20)]
    docs = docs.union(spark.createDataFrame(made, "doc_id long, text string"))
    got = sorted(map(repr, map(tuple, R.run_digests(R.find_runs(docs, make_tail=True, digest=True)).collect())))
    assert got == sorted(repr(expected(*r)) for r in docs.collect())
    short = edge.where("doc_id is null or doc_id not in (7, 8)")
    got = sorted(map(repr, map(tuple, R.run_digests(R.find_runs(short, make_tail=True, digest=True)).collect())))
    assert got == sorted(repr(expected(r.doc_id, r.text)) for r in short.collect())
    assert R.find_runs(edge).count() == edge.count()
    assert R.run_digests(R.find_runs(no_docs, make_tail=True, digest=True)).collect() == []


def test_operator_returns_texts(spark):
    docs = spark.createDataFrame([(1, "so so so so so so ends", 3)], "doc_id long, text string, runs int")
    row = R.find_runs(docs, keys=("doc_id", "runs")).select("_keys.*", F.col("runs").alias("found"), "collapsed", "n_words").first()
    assert (row.runs, row.collapsed, row.n_words) == (3, "so ends", 7)
    assert [tuple(r) for r in row.found] == [(0, 6, 1)]
    with pytest.raises(ValueError):
        R.find_runs(docs, repeats=2)
