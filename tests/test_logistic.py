"""Logistic models fitted together against separate fits, and stratified numbering."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from launchlens.operators import logistic as lo, models as mo, splits


def newton(x, y, w, penalty=1.0):
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [0.0])
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b = b - np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ b)
    return b


def rows_of(n=700, seed=5):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=n) * 3 + 50, rng.normal(size=n)
    g, e = rng.choice(["u", "v", "w"], size=n), rng.choice(list("abcdefgh"), size=n)
    y = (0.4 * (x - 50) + (g == "u") + 0.3 * (e < "d") + rng.normal(size=n) > 0.7).astype(int)
    return [(int(k), float(a) if k % 13 else None, float(b), str(c), str(d) if k % 17 else None, int(v)) for k, (a, b, c, d, v) in enumerate(zip(x, z, g, e, y))]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(), "id long, x double, z double, g string, e string, y int")


def test_each_model_equals_a_fit_of_its_own(table):
    rows = table.withColumns({"_fold": (F.col("id") % 3).cast("int"), "_tier": (F.col("id") % 4).cast("int")})
    members = [lo.Member(0, 3), lo.Member(1, 1), lo.Member(2, 3, ("x", "g")), lo.Member(2, 0, ("e_te", "e_fe"))]
    many = lo.fit(lo.prepare(rows, "y", ["x", "z"], ["g"], ["e"], members))
    data = table.orderBy("id").collect()
    found = lo.aucs(many)
    for k, m in enumerate(members):
        tr = [r for r in data if r["id"] % 3 != m.fold and r["id"] % 4 <= m.tier]
        med = {c: np.median([r[c] for r in tr if r[c] is not None]) for c in ("x", "z")}
        g = np.mean([r["y"] for r in tr])
        te, fe = {}, {}
        for v in {r["e"] for r in tr}:
            mine = [r["y"] for r in tr if r["e"] == v]
            te[v], fe[v] = (sum(mine) + 10 * g) / (len(mine) + 10), len(mine) / len(tr)

        def raw(r, med=med, te=te, fe=fe, g=g):
            return [*(med[c] if r[c] is None else r[c] for c in ("x", "z")), te.get(r["e"], g), fe.get(r["e"], 0.0)]

        num = np.array([raw(r) for r in tr])
        mean, std = num.mean(0), num.std(0)
        flags = lambda part: np.array([[float(r["g"] == v) for v in "uvw"] for r in part])
        full = lambda part: np.column_stack([(np.array([raw(r) for r in part]) - mean) / std, flags(part)])
        use = np.array([m.uses is None or n in m.uses or n.split("=")[0] in m.uses for n in many.names])
        y = np.array([r["y"] for r in tr])
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        b = newton(full(tr)[:, use], y, w)
        assert many.names == ["x", "z", "e_te", "e_fe", "g=u", "g=v", "g=w"] and many.sizes[k] == len(tr)
        assert np.allclose(many.weights[k][np.append(use, True)], b, atol=1e-4) and not many.weights[k][np.append(~use, False)].any()
        for part, mine in (("train", tr), ("valid", [r for r in data if r["id"] % 3 == m.fold])):
            s, t = np.column_stack([full(mine)[:, use], np.ones(len(mine))]) @ b, np.array([r["y"] for r in mine])
            pos, neg = s[t == 1], s[t == 0]
            assert found[(k, part)] == pytest.approx(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)), abs=2e-3)


def test_one_kind_of_label_and_no_rows(spark, table):
    one = table.withColumns({"y": F.lit(1), "_fold": F.lit(1), "_tier": F.lit(0)})
    many = lo.fit(lo.prepare(one, "y", ["x"], [], [], [lo.Member(0, 0)]))
    assert lo.aucs(many)[(0, "valid")] == 0.5
    none = lo.fit(lo.prepare(one.limit(0), "y", ["x"], ["g"], ["e"], [lo.Member(0, 0)]))
    assert none.sizes.tolist() == [0.0]


def test_numbering_and_splits_are_exact(spark, table):
    for piece in (100_000, 50):
        rows = splits.numbered(table, "id", "y", piece_rows=piece).collect()
        for label in (0, 1):
            mine = [r for r in rows if r["y"] == label]
            assert sorted(r["_place"] for r in mine) == list(range(len(mine))) and {r["_of"] for r in mine} == {len(mine)}
    train, test = splits.stratified_split(table, "id", "y", 0.2)
    for label in (0, 1):
        n, k = table.where(F.col("y") == label).count(), test.where(F.col("y") == label).count()
        assert k == round(0.2 * n) and train.where(F.col("y") == label).count() == n - k
    assert not {r["id"] for r in train.collect()} & {r["id"] for r in test.collect()}


def test_learning_curve_counts_rows(table):
    spec = mo.FeatureSpec(["x", "z"], ["g"], ["e"])
    out = mo.learning_curve(table, spec, label="y", key="id", sizes=(0.1, 0.5, 1.0)).orderBy("train_share").collect()
    n = table.count()
    assert [r["train_share"] for r in out] == [0.1, 0.5, 1.0]
    assert out[2]["train_size"] == pytest.approx(2 * n / 3, abs=0.5) and out[1]["train_size"] == pytest.approx(n / 3, abs=4)
    assert out[2]["val_auc_mean"] > 0.75 and out[2]["train_error"] == pytest.approx(1 - out[2]["train_auc_mean"])


def test_steps_are_few_and_read_the_rows_once_each(table):
    rows = table.withColumns({"_fold": F.lit(1), "_tier": F.lit(0)})
    many = lo.fit(lo.prepare(rows, "y", ["x", "z"], ["g"], ["e"], [lo.Member(0, 0)]))
    assert many.steps <= 10


def test_prepared_rows_carry_codes_and_come_from_one_read(spark, table, monkeypatch):
    """A row costs the same however many models there are, and the source is computed once."""
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    source = table.mapInArrow(count, table.schema).withColumns({"_fold": (F.col("id") % 3).cast("int"), "_tier": (F.col("id") % 4).cast("int")})
    members = [lo.Member(k % 3, k // 3) for k in range(12)]
    coded = lo.prepare(source, "y", ["x", "z"], ["g"], ["e"], members)
    assert reads.value == 700 and coded.rows.select(F.max(F.size("_e"))).first()[0] == 1
    lo.fit(coded)
    got = lo.aucs(coded)
    monkeypatch.setattr(lo, "CODED_NUMBERS", 0)
    monkeypatch.setattr(lo, "HELD_SCORES", 50)
    monkeypatch.setattr(lo, "RANGE_ROWS", 1)
    wide = lo.fit(lo.prepare(source, "y", ["x", "z"], ["g"], ["e"], members))
    assert np.allclose(wide.weights, coded.weights) and wide.encodings is None and lo.aucs(wide) == pytest.approx(got, abs=1e-12)


def test_ranges_of_scores_do_not_fall():
    p = np.unique(np.concatenate([np.random.default_rng(1).random(5000), [np.exp(-500), 1e-9, 0.25, 0.5, np.nextafter(0.5, 0), np.nextafter(0.5, 1), 1 - 1e-12, 1.0]]))
    for bits in (0, 4, 20):
        assert (np.diff(lo._range_of(p, bits)) >= 0).all()


def test_numbering_computes_its_input_once(spark, table):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    assert splits.numbered(table.mapInArrow(count, table.schema), "id", "y").count() == 700 and reads.value == 700
