"""Order statistics by radix selection against numpy."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from launchlens.operators import cohorts as co, profile as pr
from launchlens.plans import selection as se

PROBS = [0.0, 0.1, 1 / 3, 0.5, 0.75, 1.0]


def test_digits_do_not_fall_as_values_rise(spark):
    rng = random.Random(4)
    values = [2.0**e for e in range(-1074, 1024)] + [math.nextafter(2.0**e, s) for e in range(-1073, 1024) for s in (0.0, math.inf)]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-320, 308) for _ in range(2000)] + [0.0, math.inf, 5e-324, 1.7976931348623157e308, 0.1, 0.3, 7.0, 1e15 + 0.5]
    values = sorted({s * v for v in values for s in (1, -1)})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: (r["a"], r["b"]) for r in df.select("v", se.digit(F.col("v")).alias("a"), se.digit(F.col("v"), se.SECOND).alias("b")).collect()}
    digits = [got[v] for v in values]
    assert all(x[0] <= y[0] and x[1] <= y[1] for x, y in zip(digits, digits[1:]))
    assert all(b >> (se.SECOND - se.FIRST) == a for a, b in digits) and max(abs(a) for a, _ in digits) < 2 ** (se.FIRST + 12)
    odd = spark.createDataFrame([(-0.0,), (float("nan"),)], "v double").select(se.digit(F.col("v"))).collect()
    assert odd[0][0] == 0 and odd[1][0] > max(digits)[0]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    data = {
        "a": rng.exponential(size=5000), "b": np.round(rng.normal(size=3000), 1), "c": np.array([4.0]), "d": np.repeat([1.0, 9.0], 500),
        # values that differ in their last bits only, and far apart ones
        "e": 1.0 + np.arange(400) * 2.0**-52, "f": np.concatenate([-(10.0 ** np.arange(-300, 300)), 10.0 ** np.arange(-300, 300), [0.0, -0.0]]),
    }
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None), ("none", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: [r[f"q{i}"] for i in range(len(PROBS))] for r in se.exact_quantiles(df, ["g"], "v", PROBS).collect()}
    assert set(got) == {*data, None}
    for g, vs in data.items():
        assert np.allclose(got[g], np.quantile(vs, PROBS), rtol=1e-12, atol=0)
    assert np.allclose(got[None], np.quantile([2.0, 4.0], PROBS))
    whole = se.exact_quantiles(df, [], "v", [0.5]).first()["q0"]
    assert np.isclose(whole, np.quantile([v for _, v in rows if v is not None], 0.5))
    assert se.exact_quantiles(df.where("v is null"), ["g"], "v", PROBS).collect() == []


def test_no_task_orders_a_whole_group(spark):
    """Half a million different values of one group are never in one sort: a digit has fewer rows."""
    n = 500_000
    df = spark.range(n).select((F.col("id") * 0.37 + 1.0).alias("v"), F.lit(1).alias("n"))
    out = se.exact_quantiles(df, [], "v", [0.5, 0.9], weight="n")
    assert np.allclose(list(out.first()), np.quantile(np.arange(n) * 0.37 + 1.0, [0.5, 0.9]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "raise_error" not in plan


def test_weights_stand_for_rows(spark):
    rng = np.random.default_rng(6)
    v, n = rng.normal(size=300), rng.integers(1, 9, size=300)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, n)], "x double, times int")
    got = se.exact_quantiles(df, [], "x", PROBS, weight="times").first()
    assert np.allclose(list(got), np.quantile(np.repeat(v, n), PROBS))


def test_count_stats(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 20, size=400)
    counts = spark.createDataFrame([(int(x),) for x in v], "d int").groupBy("d").agg(F.count("*").alias("n"))
    row = se.count_stats(counts, [], "d").first()
    want = (len(v), v.mean(), np.median(v), v.std(), v.std(ddof=1), v.min(), v.max(), np.quantile(v, 0.25), np.quantile(v, 0.75))
    got = tuple(row[c] for c in ("count", "mean", "median", "std", "std_samp", "min", "max", "q25", "q75"))
    assert np.allclose(got, want)


def test_moments_far_from_zero(spark):
    x = 1e9 + np.random.default_rng(3).normal(size=1000)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("a", None), (None, 3.0)], "g string, x double")
    rows = {r["g"]: r for r in se.counted_moments(se.value_counts(df, ["g"], "x"), ["g"]).collect()}
    assert (rows["a"]["rows"], rows["a"]["count"]) == (1001, 1000) and np.isclose(rows["a"]["std_samp"], x.std(ddof=1), rtol=1e-6)
    assert rows[None]["std_samp"] is None and rows[None]["std"] == 0.0


def test_medians_leave_out_missing_values(spark):
    df = spark.createDataFrame([(1.0, None, 5), (2.0, None, 7), (float("nan"), None, None), (4.0, None, 9)], "a double, b double, `c d` int")
    assert se.exact_medians(df, ["a", "b", "c d"]) == {"a": 2.0, "c d": 7.0}


def test_sources_are_read_once(spark, tmp_path):
    """Box numbers and column statistics come from one counted table; what is planned after it holds no file scan."""
    path = str(tmp_path / "rows")
    spark.createDataFrame([("a", float(k)) for k in range(50)], "g string, x double").write.parquet(path)
    rows = spark.read.parquet(path)
    for out in (co.box_stats(rows, ["g"], "x"), pr.describe_numeric(rows, ["x"])):
        assert out.count() == 1 and "FileScan" not in out._jdf.queryExecution().executedPlan().toString()
