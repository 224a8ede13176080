"""The skew-safe helpers against brute force, with hot keys, ties and nulls."""

import random

import numpy as np
import pytest
from frames import rows_of
from pyspark.sql import functions as F

from launchlens.plans import skew as sk


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(k, "hot" if rng.random() < 0.4 else f"k{rng.randrange(5)}", rng.randrange(300), rng.choice([None, *range(50)])) for k in range(2000)]
    return rows, spark.createDataFrame(rows, "id int, key string, pos int, v int")


def test_ordinal(table):
    rows, df = table
    got = {r["id"]: r["o"] for r in sk.ordinal(df, ["key"], [F.col("pos"), F.col("id")], F.floor(F.col("pos") / 7), "o").collect()}
    for key in {r[1] for r in rows}:
        for place, row in enumerate(sorted((r[2], r[0]) for r in rows if r[1] == key), 1):
            assert got[row[1]] == place
    whole = {r["id"]: r["o"] for r in sk.ordinal(df, [], [F.col("pos"), F.col("id")], F.floor(F.col("pos") / 7), "o").collect()}
    assert [whole[i] for _, i in sorted((r[2], r[0]) for r in rows)] == list(range(1, len(rows) + 1))


def test_weighted_ordinal(table):
    rows, df = table
    weighted = df.withColumn("w", F.col("id") % 3)
    got = {r["id"]: r["o"] for r in sk.ordinal(weighted, ["key"], [F.col("pos"), F.col("id")], F.floor(F.col("pos") / 7), "o", weight="w").collect()}
    for key in {r[1] for r in rows}:
        total = 0
        for _, i in sorted((r[2], r[0]) for r in rows if r[1] == key):
            assert got[i] == total
            total += i % 3


@pytest.mark.parametrize("later", [False, True])
def test_running_extreme_strict(table, later):
    rows, df = table
    out = sk.running_extreme(df, ["key"], "pos", F.floor(F.col("pos") / 11), {"lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}, later=later)
    by_key = {}
    for r in rows:
        by_key.setdefault(r[1], []).append(r)
    for r in out.collect():
        seen = [x[3] for x in by_key[r["key"]] if x[3] is not None and (x[2] > r["pos"] if later else x[2] < r["pos"])]
        assert (r["lo"], r["hi"]) == ((min(seen), max(seen)) if seen else (None, None))


def test_running_extreme_with_ties(table):
    rows, df = table
    out = sk.running_extreme(df, ["key"], "pos", F.floor(F.col("pos") / 11), {"hi": ("max", F.col("v"))}, ties=[F.col("id")])
    for r in out.collect():
        seen = [x[3] for x in rows if x[1] == r["key"] and x[3] is not None and (x[2], x[0]) < (r["pos"], r["id"])]
        assert r["hi"] == (max(seen) if seen else None)


def test_previous_value(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 5, 9, 30, 31)] + [("b", 7)], "key string, x int")
    out = sk.previous_value(df, ["key"], "x", F.floor(F.col("x") / 10), "prev")
    assert {(r["key"], r["x"]): r["prev"] for r in out.collect()} == {("a", 1): None, ("a", 5): 1, ("a", 9): 5, ("a", 30): 9, ("a", 31): 30, ("b", 7): None}


def test_first_and_last_row(table):
    rows, df = table
    first = {r["key"]: r["id"] for r in sk.first_row(df, ["key"], [F.col("pos"), F.col("id")]).collect()}
    last = {r["key"]: r["id"] for r in sk.last_row(df, ["key"], [F.col("pos"), F.col("id")]).collect()}
    for key in {r[1] for r in rows}:
        mine = sorted((r[2], r[0]) for r in rows if r[1] == key)
        assert (first[key], last[key]) == (mine[0][1], mine[-1][1])


def test_range_join(spark):
    from datetime import date, datetime, timedelta

    rng = random.Random(5)
    base = datetime(2024, 1, 1)
    pts = [(k, base + timedelta(hours=rng.randrange(24 * 400))) for k in range(300)]
    spans = []
    for k in range(20):
        a = date(2024, 1, 1) + timedelta(days=rng.randrange(300))
        spans.append((f"r{k}", a, a + timedelta(days=rng.randrange(120))))
    out = sk.range_join(spark.createDataFrame(pts, "id int, ts timestamp"), "ts", spark.createDataFrame(spans, "r string, a date, b date"), "a", "b")
    want = sorted((i, r) for i, x in pts for r, a, b in spans if datetime(a.year, a.month, a.day) <= x <= datetime(b.year, b.month, b.day))
    assert rows_of(out, "id", "r") == want
    assert "Nested" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
