"""Hard negatives against SQL and brute force."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from launchlens.llm import hard_negatives as H

SCHEMA = "id long, label int, vector array<float>, key int, windows int, score long"


def brute(rows, is_anchor, positives=5, negatives=5, low=80, scale=100):
    fine = {
        (i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        for i, lab, v, *_ in rows
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    pos, neg = {}, {}
    for a in fine:
        if is_anchor(a[0]):
            for r in fine:
                pair = (-sum(x * y for x, y in zip(a[2], r[2])), r[0])
                if a[1] != r[1]:
                    neg.setdefault(a[0], set()).add(pair)
                elif a[0] != r[0]:
                    pos.setdefault(a[0], set()).add(pair)
    out = []
    for a, pairs in pos.items():
        for p, i in sorted(pairs)[:positives]:
            hits = [(s, j) for s, j in sorted(neg.get(a, ())) if low * -p <= scale * -s <= scale * -p]
            out += [(a, i, n, j, -p, -s) for n, (s, j) in enumerate(hits[:negatives], 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, 5, 5) for r in rows], SCHEMA)


def test_ties_repeats_and_small_blocks(spark):
    rng = random.Random(4)
    # few different vectors, so ties, copies and scores below and at zero are frequent
    rows = [(i, rng.randrange(3), [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(3)]) for i in range(160)]
    rows += [(7, 1, [0.5, 0.25]), (20, 0, [0.25, 0.25, 0.25]), (20, 2, [0.5, 0.5, 0.5]), (30, 1, []), (31, 2, [])] + rows[:20]
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 100
    for chunk, block in ((8192, 2048), (25, 3)):
        assert mined(H.mine(frame(spark, rows), F.col("id") % 10 == 0, chunk_rows=chunk, block_anchors=block)) == want
    got = mined(H.mine(frame(spark, rows), F.col("id") % 10 == 0, positives=2, negatives=3, low=50, scale=75, chunk_rows=40))
    assert got == brute(rows, lambda i: i % 10 == 0, 2, 3, 50, 75)


def test_one_label_and_a_large_group_of_copies(spark):
    rows = [(i, 1, [0.5, 0.5]) for i in range(300)] + [(1000 + i, 2, [0.5, 0.5]) for i in range(300)]
    want = brute(rows, lambda i: i % 100 == 0)
    assert mined(H.mine(frame(spark, rows), F.col("id") % 100 == 0, chunk_rows=64)) == want
    assert want[0] == (0, 1, 1, 1000, 32768, 32768)
    assert mined(H.mine(frame(spark, rows[:300]), F.col("id") % 100 == 0)) == []


def test_rows_that_take_no_part(spark):
    good = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.9]), (2, 2, [0.9, 0.9])]
    bad = [(None, 1, [1.0, 1.0]), (3, None, [1.0, 1.0]), (4, 1, None), (5, 2, [1.0, None]), (6, 2, [float("nan"), 1.0]), (8, 2, [float("inf"), 1.0])]
    want = brute(good, lambda i: i == 0)
    assert want and mined(H.mine(frame(spark, good + bad), F.col("id") == 0)) == want
    assert mined(H.mine(frame(spark, []), F.col("id") == 0)) == []


def test_keys_sort_as_numbers():
    rng = np.random.default_rng(1)
    a, s, i = (rng.integers(-(2**62), 2**62, 200) for _ in range(3))
    a = a % 3 - 1
    keys = H.pack_keys(a, s, H.NEGATIVE, i)
    back = list(H.unpack_keys(pa.array(sorted(keys.to_pylist()))))
    assert back == sorted(zip(a.tolist(), s.tolist(), [1] * 200, i.tolist()), key=lambda r: (r[0], -r[1], r[2], r[3]))


def test_large_components_stay_exact(spark):
    rows = [(0, 1, [3.0e6, 1.0]), (1, 1, [3.0e6, 2.0]), (2, 2, [2.9e6, 7.0]), (3, 2, [2.9e6, 8.0])]
    assert mined(H.mine(frame(spark, rows), F.col("id") == 0)) == brute(rows, lambda i: i == 0)


def test_oracle_takes_changed_labels():
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings AS SELECT i AS vec_id, CAST(i % 10 AS INTEGER) AS label, [CAST(i AS FLOAT), CAST(1 AS FLOAT)] AS embedding FROM range(300) t(i)")
    assert con.execute(H.oracle()).fetchall()
