"""Linear fits from Grams against least squares, closed forms and optimality conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from launchlens.operators import linear as li, mining as mi, models as mo


def fixture(spark, n=900, seed=8):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n) + 1000, rng.exponential(size=n)
    c, d = rng.choice(["p", "q", "r"], size=n), rng.choice(["x", "y"], size=n)
    y = 3 * a - 2 * b + 5 * (c == "p") + 4 * ((c == "q") & (d == "x")) + rng.normal(scale=0.3, size=n)
    rows = [(int(k), float(u) if k % 11 else None, float(v), str(e) if k % 7 else None, str(f), float(w)) for k, (u, v, e, f, w) in enumerate(zip(a, b, c, d, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, d string, y double")


@pytest.fixture(scope="module")
def table(spark):
    return fixture(spark)


def dense(rows):
    got = rows.orderBy("_key").collect()
    return np.array([r["f"] for r in got]), np.array([r["label"] for r in got]), np.array([r["_fold"] for r in got])


@pytest.fixture(scope="module")
def prepared(table):
    pairs = mi.interactions(table, ["c", "d"], 0.03, 0.01)
    shape = li.design(table, "y", ["a", "b"], ["c", "d"], 0.03, pairs)
    rows = li.kept_rows(table, shape, "y", "id", F.col("id") % 5 == 0, 4)
    x, y, fold = dense(rows.withColumn("f", shape.features()))
    return shape, li.grams(rows, shape, F.col("_fold"), 5), x, y, fold


def test_features_hold_products_of_values(table, prepared):
    shape, _, x, _, _ = prepared
    assert len(shape.names) == 2 + 4 + 2 + 8 == x.shape[1]
    k = shape.names.index("c=q&d=x") if "c=q&d=x" in shape.names else shape.names.index("d=x&c=q")
    want = [float(r["c"] == "q" and r["d"] == "x") for r in table.orderBy("id").collect()]
    assert x[:, k].tolist() == want
    a = [r["a"] for r in table.orderBy("id").collect()]
    assert np.allclose(x[:, 0], np.where([v is None for v in a], np.median([v for v in a if v is not None]), [v or 0 for v in a]))


def test_grams_are_the_sums_of_products(prepared):
    shape, grams, x, y, fold = prepared
    for f, g in enumerate(grams):
        full = np.column_stack([np.ones((fold == f).sum()), x[fold == f], y[fold == f]])
        full[:, 1:] -= g.shift
        assert np.allclose(g.sums, full.T @ full, rtol=1e-10, atol=1e-6)
        w = np.arange(len(shape.names)) / 7.0
        assert np.isclose(g.mse(w, 2.5), np.mean((y[fold == f] - x[fold == f] @ w - 2.5) ** 2), rtol=1e-8)


def test_least_squares_is_the_smallest_solution(prepared):
    _, grams, x, y, fold = prepared
    total = grams[1] + grams[2] + grams[3] + grams[4]
    w = li.least_squares(total)
    xs, ys = x[fold > 0], y[fold > 0]
    want = np.linalg.lstsq(xs - xs.mean(0), ys - ys.mean(), rcond=1e-10)[0]
    assert np.allclose(w, want, atol=1e-6)


def test_ridge_path_solves_the_normal_equations(prepared):
    _, grams, x, y, fold = prepared
    total = grams[1] + grams[2]
    at = (fold == 1) | (fold == 2)
    xs, ys = x[at] - x[at].mean(0), y[at] - y[at].mean()
    for a, w in zip((1e-4, 0.1, 10.0, 1e3), li.ridge_path(total, (1e-4, 0.1, 10.0, 1e3))):
        want = np.linalg.solve(xs.T @ xs + a * np.eye(xs.shape[1]), xs.T @ ys)
        assert np.allclose(w, want, atol=1e-5)


def test_lasso_path_meets_the_optimality_conditions(prepared):
    _, grams, x, y, fold = prepared
    penalties = [1e-3, 0.05, 0.4, 50.0]
    parts = [grams[1], grams[2] + grams[3]]
    for g, path in zip(parts, li.lasso_path(parts, penalties)):
        square, _ = g.centred()
        for a, w in zip(penalties, path):
            slope = (square[:-1, -1] - square[:-1, :-1] @ w) / g.n
            on = w != 0
            assert np.allclose(slope[on], a * np.sign(w[on]), atol=1e-5) and (np.abs(slope[~on]) <= a + 1e-5).all()
    square, _ = parts[0].centred()
    top = np.abs(square[:-1, -1] / parts[0].n).max()
    assert not li.lasso_path(parts[:1], [1.001 * top]).any() and li.lasso_path(parts[:1], [0.9 * top]).any()


def test_cross_validation_takes_the_least_error(prepared):
    _, grams, x, y, fold = prepared
    folds = grams[1:]
    total = folds[0] + folds[1] + folds[2] + folds[3]
    grid = [1e-3, 1.0, 1e3, 1e6]
    w, best = li.cross_validated(total, folds, "ridge", grid)
    errors = []
    for a in grid:
        e = 0.0
        for f in range(1, 5):
            tr, te = (fold > 0) & (fold != f), fold == f
            xs, m = x[tr] - x[tr].mean(0), x[tr].mean(0)
            v = np.linalg.solve(xs.T @ xs + a * np.eye(xs.shape[1]), xs.T @ (y[tr] - y[tr].mean()))
            e += np.mean((y[te] - (x[te] - m) @ v - y[tr].mean()) ** 2)
        errors.append(e)
    assert best == grid[int(np.argmin(errors))] and np.allclose(w, li.ridge_path(total, [best])[0])


@pytest.mark.parametrize("kind", ["ols", "lasso", "ridge"])
def test_interactions_reach_the_model(table, kind):
    pairs = mi.interactions(table, ["c", "d"], 0.03, 0.01)
    without = mo.price_fit(table, "y", ["a", "b"], ["c", "d"], kind, alphas=[1e-3] if kind != "ols" else None)
    joint = mo.price_fit(table, "y", ["a", "b"], ["c", "d"], kind, pairs=pairs, alphas=[1e-3] if kind != "ols" else None)
    assert joint.metrics["rmse"] < 0.8 * without.metrics["rmse"]
    assert joint.metrics["r2"] > without.metrics["r2"] and len(joint.names) == len(without.names) + 8
    assert {r["section"] for r in joint.table(table.sparkSession).collect()} == {"metric", "feature"}


def test_importance_of_a_linear_model_is_the_mean_over_permutations(spark):
    table = fixture(spark, 240, 3)
    fit = mo.price_fit(table, "y", ["a", "b"], ["c"], "ols")
    got = {r["feature"]: r["rise"] for r in mo.perm_importance(fit).collect()}
    rows = fit.test.collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])
    w, b = fit.model.coefficients, fit.model.intercept
    base = np.sqrt(np.mean((y - x @ w - b) ** 2))
    assert np.isclose(base, fit.metrics["rmse"])
    for j, name in enumerate(fit.names):
        # the mean over all donors of every row
        e = (y - x @ w - b)[:, None] + w[j] * (x[:, j][:, None] - x[:, j][None, :])
        assert np.isclose(got[name], np.sqrt(np.mean(e**2)) - base, atol=1e-6)


def test_importance_of_trees_scores_once(spark):
    table = fixture(spark, 500, 4)
    fit = mo.price_fit(table, "y", ["a", "b"], ["c"], "gbt", trees=10, depth=3)
    got = {r["feature"]: r["rise"] for r in mo.perm_importance(fit, piece_rows=17).collect()}
    assert set(got) == set(fit.names) and got["a"] > got["b"] > 0
    assert [r["feature"] for r in mo.perm_importance(fit, ["b"]).collect()] == ["b"]


def test_missing_columns_and_empty_tables(spark):
    df = fixture(spark, 60, 5).withColumn("z", F.lit(None).cast("double"))
    fit = mo.price_fit(df, "y", ["a", "z"], ["c"], "ridge", alphas=[0.1])
    assert dict(zip(fit.names, fit.model.coefficients))["z"] == pytest.approx(0.0, abs=1e-9)
    none = mo.price_fit(df.where("id < 0"), "y", ["a"], [], "ols")
    assert none.model.coefficients.tolist() == [0.0] and mo.perm_importance(none).count() == 1
