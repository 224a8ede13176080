"""Boosted trees over counted cells against MLlib's, per-row scoring and brute force."""

import inspect

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor as PerRow
from pyspark.sql import functions as F

from launchlens.catalog import price_queries as pq
from launchlens.operators import boosting as bo, linear as li, mining as mi, models as mo


def fixture(spark, n=800, seed=5):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 12, n), rng.integers(0, 7, n)
    c, d = rng.choice(["p", "q", "r"], size=n), rng.choice(["x", "y", "z"], size=n)
    y = 3.0 * a - 2.0 * b * (c == "p") + 9 * ((c == "q") & (d == "x")) + rng.normal(size=n) + 100
    rows = [(int(k), float(u) if k % 11 else None, float(v), str(e) if k % 7 else None, str(f), float(w)) for k, (u, v, e, f, w) in enumerate(zip(a, b, c, d, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, d string, y double")


@pytest.fixture(scope="module")
def encoded(spark):
    table = fixture(spark)
    pairs = mi.interactions(table, ["c", "d"], 0.03, 0.01)
    shape = li.design(table, "y", ["a", "b"], ["c", "d"], 0.03, pairs)
    rows = li.kept_rows(table, shape, "y", "id", F.lit(False), 4)
    return shape, rows, bo.Layout.of(rows, shape)


def test_trees_are_those_of_mllib(encoded):
    shape, rows, layout = encoded
    model = bo.GBTRegressor(layout, maxIter=8, maxDepth=3, stepSize=0.2, seed=1).fit(layout.counted(rows))
    plain = rows.select("_key", "label", array_to_vector(shape.features()).alias("features"))
    theirs = PerRow(maxIter=8, maxDepth=3, stepSize=0.2, seed=1).fit(plain)
    want = {r["_key"]: r["prediction"] for r in theirs.transform(plain).collect()}
    for scored in (model.scored(rows.select("_key", *layout.cell())), model.transform(rows.select("_key", shape.features().alias("features")))):
        got = {r["_key"]: r["prediction"] for r in scored.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    assert np.allclose(model.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-8)


def test_cells_in_spark_and_in_one_task_give_the_same_trees(encoded, monkeypatch):
    shape, rows, layout = encoded
    fit = lambda: bo.GBTRegressor(layout, maxIter=13, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=3).fit(layout.counted(rows).repartition(3))
    held = fit()
    monkeypatch.setattr(bo, "HELD_BYTES", 0)
    spread = fit()
    x = np.unique(layout.matrix(np.arange(int(np.prod(layout.bases)))[:, None]), axis=0)
    assert np.allclose(held.score(x), spread.score(x)) and np.allclose(held.gains, spread.gains)


def test_a_task_holds_what_bins_bound():
    bins = bo.Layout([[float(k) for k in range(31)]] * 2 + [[float(k) for k in range(10)]], [[0, 1, 2], [3, 4, 5, 6, 7, 8]], [])
    many = bo.Layout([[float(k) for k in range(31)]] * 20, [], [])
    assert bins.held_bytes(20 * 32 * 32 * 11 * 18) < bo.HELD_BYTES < many.held_bytes(3_000_000)


def test_many_values_are_cut_at_exact_quantiles(spark):
    rows = spark.range(5000).select(F.array(F.col("id").cast("double"), (F.col("id") % 3).cast("double")).alias("_x"))
    many, few = bo.cuts_of(rows, 2)
    assert np.allclose(many, np.quantile(np.arange(5000), np.arange(1, 32) / 32)) and few == [0.5, 1.5]


def test_words_hold_any_number_of_columns(spark):
    layout = bo.Layout([[float(k) for k in range(31)]] * 20, [[0, 1], [2]], [(0, 2)])
    assert len(layout.words) == 2
    rng = np.random.default_rng(2)
    x, codes = rng.uniform(-1, 32, (50, 20)), np.column_stack([rng.integers(-1, 2, 50), rng.choice([-1, 2], 50)])
    df = spark.createDataFrame([(u.tolist(), v.tolist()) for u, v in zip(x, codes)], "_x array<double>, _codes array<int>")
    words = np.array([tuple(r) for r in df.select(*layout.cell()).collect()])
    flags = np.column_stack([codes[:, 0] == 0, codes[:, 0] == 1, codes[:, 1] == 2, (codes[:, 0] == 0) & (codes[:, 1] == 2)])
    assert (layout.matrix(words) == layout.bins(np.concatenate([x, flags], axis=1))).all()


def test_a_fit_takes_few_jobs(spark):
    """MLlib takes a job for every level of every tree."""
    table = fixture(spark, 300)
    sc = spark.sparkContext
    sc.setJobGroup("boosted", "fit")
    fit = mo.price_fit(table, "y", ["a", "b"], ["c"], "gbt", trees=60, depth=6)
    jobs = len(sc.statusTracker().getJobIdsForGroup("boosted"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert fit.metrics["r2"] > 0.5 and jobs < 60


@pytest.mark.parametrize("with_pairs", [False, True])
def test_importance_over_cells_is_that_of_single_rows(spark, with_pairs):
    table = fixture(spark, 500, 4)
    pairs = mi.interactions(table, ["c", "d"], 0.03, 0.01) if with_pairs else None
    fit = mo.price_fit(table, "y", ["a", "b"], ["c", "d"], "gbt", trees=12, depth=3, pairs=pairs, held_out=F.col("id") % 2 == 0)
    got = {r["feature"]: r["rise"] for r in mo.perm_importance(fit, piece_rows=17).collect()}
    rows = fit.test.withColumn("_h", F.xxhash64(F.lit("deal"), "_key")).orderBy("_h", "_key").collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])
    rmse = lambda x: np.sqrt(np.mean((fit.model.score(fit.model.layout.bins(x)) - y) ** 2))
    assert np.isclose(rmse(x), fit.metrics["rmse"])
    for j, name in enumerate(fit.names):
        dealt = x.copy()
        dealt[:, j] = np.roll(x[:, j], len(x) // 2)
        assert np.isclose(got[name], rmse(dealt) - rmse(x), atol=1e-8)


def test_importance_scores_cells_not_rows(spark, monkeypatch):
    table = fixture(spark, 400, 7)
    copies = table.unionByName(table.withColumn("id", F.col("id") + 1000)).unionByName(table.withColumn("id", F.col("id") + 2000))
    seen = []
    cells = bo.BoostedModel.cells
    monkeypatch.setattr(bo.BoostedModel, "cells", lambda self, df, *a, **kw: seen.append(df.count()) or cells(self, df, *a, **kw))
    fit = mo.price_fit(copies, "y", ["b"], ["c", "d"], "gbt", trees=5, depth=3, held_out=F.col("id") % 2 == 0)
    seen.clear()
    rises = mo.perm_importance(fit).collect()
    # 7 bins, 4 and 3 values; each with no flag or one of 7 turned over, where 600 rows with 8 features were 5,400 scores
    assert len(rises) == len(fit.names) == 8 and len(seen) == 1 and seen[0] <= 7 * 4 * 3 * 8


def test_empty_tables_and_no_features(spark):
    table = fixture(spark, 100)
    none = mo.price_fit(table.where("id < 0"), "y", ["a"], [], "gbt", trees=2, depth=2)
    assert none.model.featureImportances.toArray().tolist() == [0.0] and mo.perm_importance(none).count() == 0
    mean = mo.price_fit(table, "y", [], [], "gbt", trees=3, depth=2, held_out=F.col("id") % 2 == 0)
    assert mean.names == [] and mean.metrics["r2"] < 0.1


def test_price_gbt_is_registered_in_full(spark, monkeypatch):
    seen = {}
    whole = mo.price_fit
    monkeypatch.setattr(mo, "price_fit", lambda *a, **kw: seen.setdefault("fit", whole(*a, **kw)))
    assert pq.price_gbt(spark, "/root/testdata/sf0.001").count() > 3
    settings = {k: v.default for k, v in inspect.signature(whole).parameters.items()}
    assert (settings["trees"], settings["depth"]) == (400, 6)
    assert seen["fit"].model.leaves.shape == (400, 64) and np.abs(seen["fit"].model.leaves).max(axis=1).min() > 0


def test_importance_perm_is_registered_in_full(spark, monkeypatch):
    seen = {}
    whole = mo.price_fit
    monkeypatch.setattr(mo, "price_fit", lambda *a, **kw: seen.setdefault("fit", whole(*a, **kw)))
    assert pq.importance_perm(spark, "/root/testdata/sf0.001").count() == len(seen["fit"].names)
    assert seen["fit"].model.leaves.shape == (400, 64) and np.abs(seen["fit"].model.leaves).max(axis=1).min() > 0
