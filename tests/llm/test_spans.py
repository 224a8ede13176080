"""License scan and packing."""

import random
from itertools import combinations

import numpy as np

from launchlens.llm import licenses as L, packing as P, words as W


def common(template, text, shift, band):
    m, n = len(template), len(text)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1])
            if abs(j - i - shift) <= band and template[i - 1] == text[j - 1]:
                best[i][j] = max(best[i][j], best[i - 1][j - 1] + 1)
    return best[m][n]


def test_banded_alignment_against_full_table():
    rnd = random.Random(1)
    for _ in range(300):
        t = np.array([rnd.randrange(8) for _ in range(rnd.randrange(1, 14))])
        x = np.array([rnd.randrange(8) for _ in range(rnd.randrange(1, 20))])
        shift = rnd.randrange(-3, 8)
        n, first, last = L.align(t, x, shift, 30)
        assert n == common(t, x, shift, 30)
        assert not n or 0 <= first <= last < len(x)


def test_fingerprints_of_shared_runs_are_shared():
    rng = np.random.default_rng(2)
    for _ in range(50):
        run = rng.integers(0, 1000, 6).astype(np.uint64)
        grams = [np.concatenate([rng.integers(1000, 9000, rng.integers(0, 30)).astype(np.uint64), run, rng.integers(1000, 9000, rng.integers(0, 30)).astype(np.uint64)]) for _ in range(2)]
        prints = [set(g[L.winnow(g, np.zeros(len(g)), 4)].tolist()) for g in grams]
        assert prints[0] & prints[1] & set(run.tolist())


def test_scan_reports_spans_and_coverage(spark):
    mit = dict(L.TEMPLATES)["mit"]
    edited = mit.replace("free of charge", "gratis today").replace("sublicense,", "")
    rows = [
        (1, "Intro.\n" + mit + "\nend", 5.0),
        (2, "x " + edited + " Licensed under CC BY-NC 4.0. y", 5.0),
        (3, "released UNDER the\nMIT   license", 5.0),
        (4, "nothing of the kind, licensed to nobody", 5.0),
        (5, "Released under the MIT License. " * 3, 5.0),
        (None, "Released under the MIT License.", 5.0),
        (7, None, 5.0),
        (8, "", 5.0),
        (9, "filler " * 40_000 + "Licensed under the Apache License, Version 2.0. " + "filler " * 10, 5.0),
    ]
    got = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, coverage double")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.license for r in by[1]] == ["mit"] and by[1][0].coverage == 1.0
    assert rows[0][1][by[1][0].start_char : by[1][0].end_char].startswith("Permission is") and rows[0][1][by[1][0].start_char : by[1][0].end_char].endswith("NONINFRINGEMENT")
    assert [r.license for r in by[2]] == ["mit", "cc-by-nc-4.0-notice"] and 0.9 < by[2][0].coverage < 1
    assert [r.license for r in by[3]] == ["mit-notice"] and 4 not in by and 7 not in by and 8 not in by
    assert len(by[5]) == 3 and len(by[None]) == 1
    assert by[9][0].license == "apache-2.0-notice" and by[9][0].start_word == 40_000
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_siblings_and_half_licenses_are_told_apart(spark):
    of = dict(L.TEMPLATES)
    whole = [n for n in of if len(of[n].split()) > 60]
    assert {"mit-whole", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "isc", "gpl-3.0-or-later", "lgpl-3.0-or-later", "agpl-3.0-or-later", "unlicense"} <= set(whole)
    rows = [(n, f"Some text before. {of[n]} And some after.") for n in whole]
    rows += [(f"half of {n}", " ".join(of[n].split()[: len(of[n].split()) // 2])) for n in whole if n not in ("mit", "mit-whole")]
    got = {}
    for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    for n in whole:
        assert [(r.license, r.coverage) for r in got[n]] == [(n, 1.0)], n
        span = dict(rows)[n].encode()[got[n][0].start_char : got[n][0].end_char].decode()
        assert of[n].startswith(span) and len(of[n]) - len(span) <= 3
    assert not [r for d in got if d.startswith("half") for r in got[d] if not r.license.endswith("-notice")]
    cut = of["mit-whole"][: of["mit-whole"].index(" IN NO EVENT")]
    assert [r.license for r in L.scan_licenses(spark.createDataFrame([("x", cut)], "doc_id string, text string")).collect()] == ["mit"]


def padding(bounds, lengths, counts):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_buckets_are_optimal():
    rnd = random.Random(5)
    for _ in range(60):
        lengths = sorted(rnd.sample(range(60), rnd.randrange(1, 9)))
        counts = [rnd.randrange(1, 30) for _ in lengths]
        k = rnd.randrange(1, 6)
        bounds = P.optimal_buckets(lengths, counts, k)
        best = min(padding([*c, lengths[-1]], lengths, counts) for m in range(min(k, len(lengths))) for c in combinations(lengths[:-1], m))
        assert len(bounds) <= k and bounds[-1] == lengths[-1] and padding(bounds, lengths, counts) == best
    assert P.optimal_buckets([], [], 4) == []


def check_packing(rows, out, max_tokens, batch_tokens):
    pieces = sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.n_tokens) for r in out)
    want = []
    for d, t in rows:
        n = len(W.split([(t or "").encode()]).hash)
        want += [(d is None, d or 0, k, k * max_tokens, min(max_tokens, n - k * max_tokens)) for k in range(max(1, -(-n // max_tokens)))]
    assert pieces == sorted(want)
    seats, sizes = {}, {}
    for r in out:
        assert 0 <= r.padding == r.bucket_tokens - r.n_tokens
        seats.setdefault((r.bucket_tokens, r.batch), []).append(r.slot)
        sizes.setdefault(r.bucket_tokens, []).append((r.batch, r.slot, r.n_tokens))
    for (size, batch), slots in seats.items():
        room = max(1, batch_tokens // max(size, 1))
        full = batch < max(b for s, b in seats if s == size)
        assert sorted(slots) == list(range(room if full else len(slots))) and len(slots) <= room
    for placed in sizes.values():
        assert [n for _, _, n in sorted(placed)] == sorted(n for _, _, n in placed)


def test_packing_places_every_piece(spark, edge, no_docs):
    rnd = random.Random(8)
    rows = [(d, " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.choice([0, 1, 7, 7, 7, 30, 130])))) for d in range(300)] + [(7, "a b"), (7, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_packing(rows, P.pack(df, max_tokens=50, n_buckets=4, batch_tokens=200, slice_rows=20).collect(), 50, 200)
    check_packing([(r.doc_id, r.text) for r in edge.collect()], P.pack(edge).collect(), 2048, 65_536)
    assert P.pack(no_docs).collect() == []
