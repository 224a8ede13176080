"""Exact AUC and classification reports against their definitions."""

import itertools
import random

import pytest

from launchlens.operators import evaluation as ev


def pair_share(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg)) if pos and neg else None


def test_auc_is_the_share_of_ordered_pairs(spark):
    rng = random.Random(3)
    groups = {
        "ties": [(rng.randrange(2), rng.choice([0.1, 0.2, 0.2000001, 0.9])) for _ in range(200)],
        "fine": [(int(rng.random() < 0.3), 0.5 + rng.random() * 1e-9) for _ in range(200)],
        "signed": [(rng.randrange(2), rng.uniform(-5, 5)) for _ in range(200)],
        "one": [(1, 0.5), (1, 0.7)],
    }
    rows = [(g, y, s) for g, part in groups.items() for y, s in part] + [("ties", None, 0.5), ("ties", 1, None)]
    df = spark.createDataFrame(rows, "g string, y int, probability double")
    got = {r["g"]: r for r in ev.auc_by(df, "y", ["g"]).collect()}
    for g, part in groups.items():
        want = pair_share(part)
        assert got[g]["auc"] == (pytest.approx(want, abs=1e-12) if want is not None else None)
        assert (got[g]["pos"], got[g]["neg"]) == (sum(y for y, _ in part), sum(1 - y for y, _ in part))
    assert ev.auc(df.where("g = 'ties'"), "y") == pytest.approx(pair_share(groups["ties"]))
    assert ev.auc(df.where("g = 'one'"), "y") == 0.5 and ev.auc(df.limit(0), "y") == 0.5


def test_report(spark):
    rows = [(1, 0.9), (1, 0.8), (1, 0.2), (0, 0.7), (0, 0.1), (0, 0.1), (0, 0.4), (0, None), (None, 0.3)]
    out = {r["label"]: r for r in ev.class_report(spark.createDataFrame(rows, "y int, probability double"), "y").collect()}
    assert (out["1"]["hits"], out["1"]["false_hits"], out["1"]["missed"], out["1"]["support"]) == (2, 1, 1, 3)
    assert (out["0"]["hits"], out["0"]["false_hits"], out["0"]["missed"], out["0"]["support"]) == (3, 1, 1, 4)
    assert out["accuracy"]["f1"] == pytest.approx(5 / 7) and out["accuracy"]["support"] == 7
    assert out["macro avg"]["precision"] == pytest.approx((2 / 3 + 3 / 4) / 2)
    assert out["weighted avg"]["recall"] == pytest.approx((3 * 2 / 3 + 4 * 3 / 4) / 7)
    only = {r["label"]: r for r in ev.class_report(spark.createDataFrame([(0, 0.1)], "y int, probability double"), "y").collect()}
    assert only["1"]["f1"] == 0.0 and only["accuracy"]["f1"] == 1.0
