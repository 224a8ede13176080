"""Quality rules and the quality classifier."""

import re
from collections import Counter

import numpy as np

from launchlens.llm import quality_model as M, quality_rules as R, words as W

SPACE = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def brute(t):
    w = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(t), len(lines)]


def test_statistics_against_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", "a", "\n\n", "a b c a b c", "x\x0by  z\n x\n x\n\r\n\r", "é ü #*\u2003x", "a b c\na b c\na b c", "a a a a"]
    got = np.concatenate([R.block_stats([r[0] for r in rows]) for rows in W.blocks(((t.encode(),) for t in texts), 0)])
    assert (got[:, :7] == np.array([brute(t) for t in texts])).all()


def test_covering_finds_thresholds_and_keeps_the_rest():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["c"] > 0.95)
    rules = R.learn(x, bad)
    hit = np.zeros(3000, bool)
    for rule in rules:
        one = np.ones(3000, bool)
        for c in rule:
            one &= c.holds(x)
        hit |= one
    assert (hit & ~bad).sum() <= 0.03 * hit.sum() and (hit & bad).sum() > 0.8 * bad.sum()
    assert R.learn(x, np.zeros(3000, bool)) == [] and R.learn({k: v[:0] for k, v in x.items()}, bad[:0]) == []


def test_list_is_an_ordered_expression(spark, edge):
    rules = [(R.Condition("words", True, 8.0), R.Condition("upper_share", True, 0.05)), (R.Condition("words", False, 3.0),)]
    got = sorted((str(r._keys.doc_id), r.rule) for r in R.apply_rules(edge, rules).collect())
    assert ("6", 0) in got and ("4", 1) in got and ("1", 1) in got and ("7", None) in got and ("2", 1) in got


def test_rules_on_edge_rows(spark, edge, no_docs, labels):
    got = R.quality_rules(edge, labels).collect()
    assert len(got) == edge.count() and not any(r.kept for r in got if r.n_words < 50)
    assert all(r.kept for r in got if r.doc_id in (7, 8))
    assert R.quality_rules(no_docs, labels).collect() == [] and len(R.quality_rules(edge, labels.limit(0)).collect()) == len(got)


def test_context_sums_against_brute_force():
    texts = [b"a b c a", b"", b"b!! c", b"a"]
    total, index = np.zeros(M.BUCKETS * M.DIM, np.int64), M.index_vectors()
    w, row = M.word_rows(texts)
    M.add_contexts(total, w, row, index)
    want = np.zeros((M.BUCKETS, M.DIM), np.int64)
    for d in range(4):
        r = row[w.doc == d]
        for i in range(len(r)):
            for j in range(max(0, i - 2), min(len(r), i + 3)):
                if i != j:
                    for k in range(M.NONZERO):
                        want[r[i], index[r[j], k]] += 1 if k % 2 == 0 else -1
    assert (total.reshape(M.BUCKETS, M.DIM) == want).all()
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)] == [b"a", b"b", b"c", b"a", b"b", b"!!", b"c", b"a"]


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, M.DIM + 1))
    x[:, 4:] = 0
    p = 1 / (1 + np.exp(-6 * (np.abs(x[:, 0]) - 0.7)))
    y = (rng.random(4000) < p).astype(float)
    net = M.train(x[:3000], y[:3000], epochs=200)
    q = net.probability(x[3000:])
    assert ((q > 0.5) == (p[3000:] > 0.5)).mean() > 0.8
    assert abs(q.mean() - y[3000:].mean()) < 0.05
    assert 0 < M.train(x[:0], y[:0]).probability(x[:1])[0] < 1


def test_scores_ignore_held_out_labels_and_separate_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = M.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    assert got.held_out.any() and not got.held_out.all()
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    again = M.quality_scores(docs, turned).toPandas().set_index("doc_id")
    assert np.allclose(again.loc[got.doc_id].score.to_numpy(), got.score.to_numpy())
    held = got[got.held_out]
    assert held[held.quality == 1].score.mean() - held[held.quality == 0].score.mean() > 0.3
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()


def test_scores_on_edge_rows(spark, edge, no_docs, labels):
    got = M.quality_scores(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert M.quality_scores(no_docs, labels).collect() == []
    assert len(M.quality_scores(edge, labels.limit(0)).collect()) == len(got)
