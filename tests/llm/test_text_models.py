"""Byte-level BPE and context mixing."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as tok
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from launchlens.llm import bpe, context_mixing as M

SF = "/root/testdata/sf0.001"
RANKS = bpe.read_ranks(tok.path("byte_bpe_multi_50k.tiktoken"))
ENCODING = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS, tok.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abthe \n", max_size=200)))
def test_bpe_equals_the_library(text):
    ids = CODEC.encode(text)
    assert ids == ",".join(map(str, ENCODING.encode_ordinary(text)))
    assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("piece", [b"a" * 3000, b"ab" * 2000, b"the" * 1500, "é日".encode() * 700])
def test_long_pre_tokens(piece):
    assert bpe.Merger(RANKS)(piece) == ENCODING.encode_ordinary(piece.decode()) or b"\xe6" in piece
    merge = bpe.Merger({bytes([b]): b for b in range(256)} | {b"ab": 300, b"abab": 299, b"ba": 301})
    assert merge(b"ababab") == [299, 300] and not any(merge.low)


def test_bpe_query_rows(spark, edge, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: ENCODING.encode_ordinary(r.text) for r in docs.collect()}
    for r in bpe.encode_texts(docs, tok.path("byte_bpe_multi_50k.tiktoken"), tok.PATTERN).collect():
        assert r.ids == want[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(ENCODING.decode_bytes(r.ids)).hexdigest()
    run = lambda d: bpe.encode_texts(d, tok.path("byte_bpe_multi_50k.tiktoken"), tok.PATTERN, with_ids=False).collect()
    got = run(edge)
    assert len(got) == edge.count() and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0} and run(no_docs) == []


def tables(texts):
    pairs = np.zeros(65536, np.int64)
    data, first = M.byte_stream(texts)
    pairs += np.bincount(M.before(data, first, 1).astype(np.int64) << 8 | data, minlength=65536)
    code, length = M.code_trees(pairs.reshape(256, 256))
    total = np.zeros((M.N_CONTEXTS, 2 << M.SLOT_BITS), np.uint32)
    M.count_bits(total, texts, code, length)
    return code, length, total


def test_code_trees_are_complete_prefix_codes():
    code, length, _ = tables([b"some words and more words", "é".encode() * 9])
    for prev in (0, ord("s"), ord(" "), 255):
        assert sum(2.0 ** -length[prev].astype(float)) == 1.0 and length.max() < M.MAX_DEPTH
        words = sorted(format(int(c) >> (32 - int(n)), f"0{n}b") for c, n in zip(code[prev], length[prev]))
        assert not any(b.startswith(a) for a, b in zip(words, words[1:]))


def test_contexts_depend_on_the_text_alone():
    texts = [b"first text here", b"", b"second", b"x y z second"]
    together = M.contexts(*M.byte_stream(texts))[1]
    first = M.byte_stream(texts)[1]
    for d, t in enumerate(texts):
        alone = M.contexts(*M.byte_stream([t]))[1]
        for m in range(M.N_CONTEXTS):
            assert (together[m][first[d] : first[d + 1]] == alone[m]).all()


def test_bits_depend_on_the_text_and_are_fewer_for_what_was_seen():
    code, length, total = tables([b"abc abd abc", b"abd"] * 20)
    counts = total.reshape(M.N_CONTEXTS, -1, 2)
    codes = M.shrink(counts[:, :, 0]).astype(np.uint16) << 8 | M.shrink(counts[:, :, 1])
    odds = np.round(M.log_odds()[0] * 14).astype(np.int8)[codes]
    weights, correction = M.fit_mixer(codes, [b"abc abd abc"] * 5, code, length)
    texts = [b"abc abd", b"", b"qzx wvu", b"ABC abd"]
    together = M.text_bits(odds, weights, correction, texts, code, length)
    alone = [M.text_bits(odds, weights, correction, [t], code, length)[0] for t in texts]
    assert np.allclose(together, alone) and together[0] == together[3] and (together > 0).all()
    assert together[0] < 0.5 * together[2]


def test_partial_tables_add_up(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    train = M._training(docs, 7, 2)
    pairs, size = M.pair_counts(train)
    code, length = M.code_trees(pairs)
    texts = [bytes(r._text) for r in train.collect()]
    assert size == sum(len(t) + 1 for t in texts)
    total = np.zeros((M.N_CONTEXTS, 2 << M.SLOT_BITS), np.uint32)
    M.count_bits(total, texts, code, length)
    want = M.shrink(total[:, 0::2]).astype(np.uint16) << 8 | M.shrink(total[:, 1::2])
    monkeypatch.setattr(M, "FAN_IN", 2)
    assert (M.bit_tables(train, code, length, 7) == want).all()


def test_long_texts_teach_the_mixer(spark, monkeypatch):
    docs = [(i, "a plain line of text " * 3 + f"number {i}") for i in range(300)]
    longer = [*docs, (1001, " ".join(f"{i * 7919 % 10007:x}" for i in range(9000)))]
    train = lambda rows, n: M._training(spark.createDataFrame(rows, "doc_id long, text string"), 7, 2).where("not held_out").repartition(n)
    pairs, size = M.pair_counts(train(longer, 2))
    code, length = M.code_trees(pairs)
    counts = M.bit_tables(train(longer, 2), code, length, 2)
    texts = [bytes(r._text) for r in train(longer, 1).collect()]
    assert len(max(texts, key=len)) > 10_000 and len(texts) > 250
    weights, correction = M.fit_shares(train(longer, 1), counts, code, length, 1)
    short, _ = M.fit_shares(train(docs, 1), counts, code, length, 1)
    assert np.abs(weights - short).max() > 0.01
    monkeypatch.setattr(M, "PIECE_BYTES", 4096)
    alone = M.Mixer()
    alone.learn(counts, texts, code, length, M.log_odds()[1])
    assert alone.gate_bits.sum() == alone.seen == sum(int(length[p, b]) for t in texts for p, b in zip(b"\0" + t.lower(), t.lower() + b"\xff", strict=True))
    # shares are combined by the bits that they learned from
    halves, also = M.fit_shares(train(longer, 3), counts, code, length, 3)
    again, _ = M.fit_shares(train(longer, 3), counts, code, length, 3)
    assert halves.shape == weights.shape and also.shape == correction.shape and (halves == again).all() and np.isfinite(halves).all()


def test_equal_places_are_looked_at_once(spark, monkeypatch):
    text = b"a line that comes again and again, " * 3 + "é\u65e5 ".encode() * 3 + b"x" * 50
    texts = [text, b"", b"A LINE that differs", text[:7]]
    data, first = M.byte_stream(texts)
    word = M.word_states(data)
    want = Counter()
    for d, t in enumerate(texts):
        low = b"\0" * 6 + t.lower() + b"\xff"
        for i in range(len(t) + 1):
            want[int.from_bytes(low[i : i + 7], "big"), int(word[first[d] + i])] += 20
    for most in (M.PLACES, 10):
        monkeypatch.setattr(M, "PLACES", most)
        found, rows = Counter(), 0
        for window, state, n in M.places([texts[:2], texts[2:]] * 20):
            rows += len(n)
            for w, s, k in zip(window.tolist(), state.tolist(), n.tolist(), strict=True):
                found[w, s] += k
        assert found == want and (rows == len(want) or most == 10)
    # tables and scores from places are those from every byte by itself
    code, length, total = tables(texts * 20)
    alone = np.zeros_like(total)
    prev, ctx = M.contexts(data, first)
    for _, at, node, bit in M.bit_levels(data, prev, code, length):
        for m in range(M.N_CONTEXTS):
            np.add.at(alone[m], (M.slots(ctx[m], at, node) << np.uint32(1) | bit).astype(np.int64), np.uint32(20))
    assert (total == alone).all()
    stored = M.place_rows(spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts * 20)], "doc_id long, _text binary").coalesce(2))
    assert (M.bit_tables(stored, code, length, 2) == (M.shrink(total[:, 0::2]).astype(np.uint16) << 8 | M.shrink(total[:, 1::2]))).all()


def test_slots_are_looked_up_longest_code_first(monkeypatch):
    texts = [b"a line that comes again and again, " * 3, b"", b"A LINE that differs", "é\u65e5 ".encode() * 3, bytes(range(97, 123)) * 2]
    code, length, total = tables(texts * 5)
    counts = M.shrink(total[:, 0::2]).astype(np.uint16) << 8 | M.shrink(total[:, 1::2])
    odds = np.round(M.log_odds()[0] * 14).astype(np.int8)[counts]
    rows, plain = [], M.slots
    monkeypatch.setattr(M, "slots", lambda context, at, node: rows.append(at) or plain(context, at, node))
    weights, correction = M.fit_mixer(counts, texts, code, length)
    bits = M.text_bits(odds, weights, correction, texts, code, length)
    M.count_bits(total, texts, code, length)
    # no bit's contexts are gathered: those of a depth stand at the front
    assert rows and all(isinstance(at, slice) for at in rows)
    # in any other order each place costs the same, and a text the sum over its bytes
    data, first = M.byte_stream(texts)
    window, word = M.windows(data, first), M.word_states(data)
    order = M.longest_first(window, length)
    steps = length[(window[order] >> np.uint64(8) & np.uint64(255)).astype(int), data[order]].astype(int)
    assert sorted(order) == list(range(len(data))) and (np.diff(steps) <= 0).all() and len(set(steps)) > 3
    each = M.place_bits(odds, weights, correction, window, word, code, length)
    assert not all(isinstance(at, slice) for at in rows)
    assert (each[order] == M.place_bits(odds, weights, correction, window[order], word[order], code, length)).all()
    assert np.allclose(np.add.reduceat(each, first[:-1]), bits, rtol=1e-12)


def test_runs_are_told_apart_by_whole_hashes():
    # some hashes differ in leading bits only, some in the last ones only
    keys = [k << 44 for k in range(40)] + list(range(40)) + [5 << 44 | 7, 1 << 63, (1 << 63) + 1]
    rng = np.random.default_rng(3)
    key = rng.permutation(np.array(keys * 9, np.uint64))
    # the windows that have these hashes where no word has begun
    window = key ^ key >> np.uint64(29) ^ key >> np.uint64(58)
    window *= np.uint64(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    window ^= window >> np.uint64(32)
    window *= np.uint64(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    order, start = M.runs_of(window, np.zeros(len(key), np.uint32))
    assert sorted(order) == list(range(len(key)))
    runs = np.split(key[order], start[1:])
    assert all(len(set(r.tolist())) == 1 for r in runs) and len(runs) >= len(set(keys))
    # hashes whose leading bits are their own come in one run each
    often = Counter(int(r[0]) for r in runs)
    assert all(often[k << 44] == 1 for k in range(1, 40) if k != 5)


def test_base_scores_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    words = {r.doc_id: [*re.findall("[^\x20\x09-\x0d]+", r.text.translate(low)), None] for r in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in words}
    count = Counter(w for d in words if not held[d] for w in words[d])
    n, v = sum(count.values()), len(count)
    got = M.score_texts(spark.read.parquet(f"{SF}/documents.parquet"), chunk_bytes=50_000).collect()
    assert len(got) == len(rows)
    for r in got:
        want = sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in words[r.doc_id])
        assert abs(r.base_score - want) < 1e-9 * abs(want) + 1e-9 and r.held_out == held[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words[r.doc_id]), sum(count[w] > 0 for w in words[r.doc_id]), n)
        assert r.score < 0
    bits = sum(-r.score for r in got if r.held_out) / math.log10(2)
    assert bits / sum(len(r.text.encode()) for r in rows if held[r.doc_id]) < 3.2


def test_scores_on_edge_rows(spark, edge, no_docs):
    got = M.score_texts(edge).collect()
    assert len(got) == edge.count() and all(r.n_tokens == 1 for r in got if r.doc_id in (1, 2, 3))
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert M.score_texts(no_docs).collect() == []
