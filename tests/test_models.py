"""Models, matching, mining: properties and closed forms on small inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from launchlens.operators import causal as ca, mining as mi, models as mo
from launchlens.operators.encoding import TargetFreqEncoder, TargetFreqModel


def maximal(t, c, pairs, caliper):
    """No unmatched treated and control lie inside the caliper."""
    free_t = sorted(s for k, s in t.items() if k not in {a for a, _ in pairs})
    free_c = sorted(s for k, s in c.items() if k not in {b for _, b in pairs})
    return all(abs(a - b) > caliper for a, b in itertools.product(free_t, free_c))


@pytest.mark.parametrize("kind", ["spread", "hot", "gap"])
def test_matching(spark, kind):
    rng = random.Random(11)
    if kind == "spread":
        scores = [(k, int(rng.random() < 0.4), rng.random()) for k in range(400)]
    elif kind == "hot":  # half of all rows share one score
        scores = [(k, int(rng.random() < 0.5), 0.3 if rng.random() < 0.5 else rng.random()) for k in range(300)]
    else:  # sides sit in neighbouring cells
        scores = [(k, 1, 0.0999 - 0.0004 * k) for k in range(60)] + [(100 + k, 0, 0.1001 + 0.0009 * k) for k in range(60)]
    df = spark.createDataFrame(scores, "order_id long, treat int, score double")
    caliper = 0.05
    pairs = [(r["treated_key"], r["control_key"], r["score"], r["control_score"]) for r in ca.psm_match(df, "treat", caliper=caliper).collect()]
    t, c = {k: s for k, w, s in scores if w}, {k: s for k, w, s in scores if not w}
    assert pairs and all(abs(a - b) <= caliper for *_, a, b in pairs)
    assert len({p[0] for p in pairs}) == len(pairs) == len({p[1] for p in pairs})
    assert all(t[p[0]] == p[2] and c[p[1]] == p[3] for p in pairs)
    assert maximal(t, c, [p[:2] for p in pairs], caliper)


def test_smd_of_constant_feature(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (0, 1.0), (0, 1.0)], "t int, f double")
    assert ca.smd(df, "t", ["f"]).first()["smd"] == 0.0


def test_att_of_one_pair(spark):
    row = ca.att(spark.createDataFrame([(1, 0)], "a int, b int"), "a", "b").first()
    assert tuple(row) == (1, 1.0, 1.0, 1.0)


def test_encoder_unseen_and_null(spark, tmp_path):
    train = spark.createDataFrame([("a", 1), ("a", 0), (None, 1), ("b", 1)], "c string, purchase int")
    enc = TargetFreqEncoder(inputCols=["c"], alpha=10.0).fit(train)
    enc.save(str(tmp_path / "enc"))
    back = TargetFreqModel.load(str(tmp_path / "enc"))
    chain = Pipeline(stages=[TargetFreqEncoder(inputCols=["c"]), VectorAssembler(inputCols=["c_te", "c_fe"], outputCol="v")]).fit(train)
    chain.write().save(str(tmp_path / "chain"))
    for m in (enc, back, PipelineModel.load(str(tmp_path / "chain"))):
        got = {r["c"]: (round(r["c_te"], 6), r["c_fe"]) for r in m.transform(spark.createDataFrame([("a",), (None,), ("new",)], "c string")).collect()}
        assert got == {"a": (round((1 + 7.5) / 12, 6), 0.5), None: (round((1 + 7.5) / 11, 6), 0.25), "new": (0.75, 0.0)}


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(4)
    x, g = rng.normal(size=1500), rng.choice(["u", "v"], size=1500)
    y = (x + (g == "u") + rng.normal(scale=0.5, size=1500) > 0.5).astype(int)
    rows = [(int(k), float(a) if k % 17 else None, str(b), int(c)) for k, (a, b, c) in enumerate(zip(x, g, y))]
    return spark.createDataFrame(rows, "order_id long, x double, g string, purchase int")


SPEC = mo.FeatureSpec(numeric=["x"], categorical=["g"])


def test_training_picks_best_and_survives_saving(spark, learnable, tmp_path):
    fit = lambda: mo.train_conversion(learnable, SPEC, candidates={"logistic": LogisticRegression(maxIter=30), "weak": LogisticRegression(maxIter=30, regParam=50.0, elasticNetParam=1.0)})
    first, second = fit(), fit()
    assert first.best == "logistic" and first.aucs["logistic"] > 0.9
    assert first.aucs == second.aucs
    report = {(r["model"], r["label"]): r for r in first.report().collect()}
    pos, neg = report[("logistic", "1")], report[("logistic", "0")]
    assert pos["false_hits"] == neg["missed"] and pos["missed"] == neg["false_hits"]
    model = first.models["logistic"]
    model.save(str(tmp_path / "m"))
    back = mo.ConversionModel.load(spark, str(tmp_path / "m"))
    key = lambda d: {r["order_id"]: r["probability"] for r in d.select("order_id", "probability").collect()}
    assert key(model.transform(learnable)) == key(back.transform(learnable))


def test_ablation_and_learning_curve(learnable):
    noise = learnable.withColumn("noise", mo.uniform("order_id", 99))
    out = {(r["section"], r["name"]): r["value"] for r in mo.ablation(noise, "noise", SPEC).collect()}
    assert out[("auc", "base")] > 0.9 and abs(out[("auc", "feature_only")] - 0.5) < 0.12
    rows = mo.learning_curve(learnable, SPEC, sizes=(0.2, 1.0)).orderBy("train_share").collect()
    assert [r["train_share"] for r in rows] == [0.2, 1.0] and rows[1]["val_auc_mean"] > 0.9


def test_ols_matches_least_squares(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=600), rng.choice(["p", "q"], size=600)
    y = 3 * a + 5 * (b == "p") + 7
    rows = [(int(k), float(u), str(v), float(w)) for k, (u, v, w) in enumerate(zip(a, b, y))]
    df = spark.createDataFrame(rows, "id long, a double, b string, y double")
    fit = mo.price_fit(df, "y", ["a"], ["b"], "ols")
    coef = dict(zip(fit.names, fit.model.coefficients))
    assert abs(coef["a"] - 3) < 1e-6 and abs(coef["b=p"] - coef["b=q"] - 5) < 1e-6 and fit.metrics["r2"] > 0.999999
    rise = {r["feature"]: r["rise"] for r in mo.perm_importance(fit).collect()}
    assert rise["a"] > 1 and rise["b=p"] > 0.1


def brute_itemsets(rows, sup, max_len):
    n, out = len(rows), {}
    items = sorted({i for r in rows for i in r})
    for k in range(1, max_len + 1):
        for s in itertools.combinations(items, k):
            c = sum(set(s) <= r for r in rows)
            if c / n >= sup:
                out[s] = c
    return out


def test_itemsets_and_rules(spark):
    rng = random.Random(6)
    raw = [(rng.choice("ab"), rng.choice("xyz"), rng.choice([True, False]), rng.choice([0, 1, None]), rng.choice([1, 2, 3])) for _ in range(300)]
    df = spark.createDataFrame(raw, "c string, d string, f boolean, z int, i int")
    rows = [{f"c={c}", f"d={d}", f"i={i}"} | ({"f=True"} if f else set()) | ({"z=1"} if z == 1 else set()) for c, d, f, z, i in raw]
    sets = mi.freq_itemsets(mi.itemize(df, ["c", "d", "f", "z", "i"], 0.05), 0.1, 3)
    want = brute_itemsets(rows, 0.1, 3)
    assert {tuple(r["itemset"]): r["count"] for r in sets.collect()} == want
    rules = {(r["antecedent"], r["consequent"]): r for r in mi.assoc_rules(sets, 1.0, 0.5).collect()}
    expected = set()
    n = len(rows)
    for s, c in want.items():
        for k in range(1, len(s)):
            for a in itertools.combinations(s, k):
                b = tuple(x for x in s if x not in a)
                conf, lift = c / want[a], c / want[a] / (want[b] / n)
                if lift >= 1.0 + 1e-9 and conf >= 0.5 + 1e-9:
                    expected.add((" & ".join(a), " & ".join(b)))
    assert expected <= set(rules) and len(rules) - len(expected) <= 2
    r = next(iter(rules.values()))
    assert abs(r["lift"] * (r["support"] - r["leverage"]) - r["support"]) < 1e-9


def test_kinds_and_bins_from_counts(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v), k % 2, k % 7) for g in "ab" for k, v in enumerate(rng.normal(size=500))]
    df = spark.createDataFrame(rows, "g string, v double, z int, i int")
    kinds, edges = mi.column_kinds(df, ["g", "v", "z", "i"], "g")
    assert kinds == {"g": "category", "v": "binned", "z": "binary", "i": "category"}
    for r in edges.collect():
        want = np.quantile([x[1] for x in rows if x[0] == r["cls"]], [1 / 3, 2 / 3])
        assert np.allclose([r["q0"], r["q1"]], want)


def test_mix_inference(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), float(a), str(g), int(a < 40)) for k, (a, g) in enumerate(zip(rng.integers(20, 60, 800), rng.choice(["m", "f"], 800)))]
    every = spark.createDataFrame(rows, "id long, age double, gender string, label int")
    mix = mo.mix_inference(every.where("id % 4 = 0"), every.drop("label"), "label", ["age"], ["gender"], key="id", trees=10, depth=3)
    row, scored = mix.result.first(), mix.scored
    report = {r["label"]: r for r in mix.report.collect()}
    # 30 % of each label, to the row
    labels = [r[3] for r in rows if r[0] % 4 == 0]
    assert (report["1"]["support"], report["0"]["support"]) == tuple(round(0.3 * labels.count(y)) for y in (1, 0))
    assert report["accuracy"]["f1"] > 0.9 and report["1"]["auc"] > 0.95
    gains = {r["feature"]: r["importance"] for r in mix.importances.collect()}
    assert set(gains) == {"age", "gender"} and gains["age"] > 0.9
    assert row["orders"] == 800 and abs(row["share"] + row["other_share"] - 1) < 1e-9 and 0.5 <= row["calibration_factor"] <= 1
    assert abs(row["share"] - np.mean([r[3] for r in rows])) < 0.1 and scored.count() == 800


def greedy(t, c, caliper):
    """A walk over both sides in score order: each treated takes the nearer of the controls around it, if free and inside the caliper."""
    ts, cs = sorted((s, k) for k, s in t.items()), sorted((s, k) for k, s in c.items())
    j, used, gaps = 0, set(), []
    for s, _ in ts:
        while j < len(cs) - 1 and cs[j][0] < s:
            j += 1
        near = [(abs(cs[i][0] - s), i) for i in (j, j - 1) if 0 <= i < len(cs) and i not in used]
        near = [x for x in near if x[0] <= caliper]
        if near:
            d, i = min(near)
            used.add(i)
            gaps.append(d)
    return gaps


def test_mutual_matches_are_no_farther_than_a_sequential_walk(spark):
    rng = random.Random(21)
    rows = [(k, int(rng.random() < 0.35), round(rng.betavariate(2, 5), 4)) for k in range(600)]
    df = spark.createDataFrame(rows, "order_id long, treat int, score double")
    pairs = ca.psm_match(df, "treat", caliper=0.05)
    got = [abs(r["score"] - r["control_score"]) for r in pairs.collect()]
    want = greedy({k: s for k, w, s in rows if w}, {k: s for k, w, s in rows if not w}, 0.05)
    assert len(got) >= len(want) and np.mean(sorted(got)[: len(want)]) <= np.mean(want) + 1e-12
    check = ca.match_check(df, pairs, "treat", 0.05).first()
    t, c = (sorted(s for _, w, s in rows if w == side) for side in (1, 0))
    assert check["same_score"] == sum(min(t.count(s), c.count(s)) for s in set(t)) and tuple(check)[1:] == (0, 0, 0)


def test_balance_over_all_encoded_covariates(spark):
    rng = np.random.default_rng(6)
    n = 600
    x, g, e = rng.normal(size=n), rng.choice(["u", "v"], size=n), rng.choice(list("abcd"), size=n)
    t = (x + (g == "u") + rng.normal(size=n) > 0.8).astype(int)
    df = spark.createDataFrame([(int(k), float(a), str(b), str(c), int(w)) for k, (a, b, c, w) in enumerate(zip(x, g, e, t))], "order_id long, x double, g string, e string, t int")
    scores = ca.propensity(df, "t", mo.FeatureSpec(["x"], ["g"], ["e"]))
    before = {r["feature"]: r["smd"] for r in scores.smd().collect()}
    assert set(before) == {"x", "e_te", "e_fe", "g=u", "g=v"}
    want = abs(x[t == 1].mean() - x[t == 0].mean()) / np.sqrt((x[t == 1].var(ddof=1) + x[t == 0].var(ddof=1)) / 2)
    assert before["x"] == pytest.approx(want)
    pairs = ca.psm_match(scores.scores, "t", caliper=0.02)
    after = {r["feature"]: r["smd"] for r in scores.smd(pairs.select(F.explode(F.array("treated_key", "control_key")))).collect()}
    assert after["x"] < 0.3 * before["x"]


def test_matching_takes_few_jobs(spark):
    """Each job's plan and classes stay on the driver for a while; rounds of matching took hundreds."""
    rng = random.Random(3)
    rows = [(k, int(rng.random() < 0.4), rng.random() ** 3) for k in range(3000)]
    df = spark.createDataFrame(rows, "order_id long, treat int, score double")
    sc = spark.sparkContext
    sc.setJobGroup("few-jobs", "matching")
    pairs = ca.psm_match(df, "treat", caliper=0.01)
    jobs = len(sc.statusTracker().getJobIdsForGroup("few-jobs"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert pairs.count() and tuple(ca.match_check(df, pairs, "treat", 0.01).first())[1:] == (0, 0, 0)
    assert jobs < 40


@pytest.mark.parametrize("piece", [5, 37])
def test_matching_in_pieces_is_nearest_first(spark, piece):
    rng = random.Random(8)
    rows = [(k, int(rng.random() < 0.45), rng.randrange(4000) / 4000) for k in range(500)]
    left = spark.createDataFrame(rows, "key long, treated int, score double")
    pairs, _ = ca._nearest_pairs(left, 0.02, piece_rows=piece)
    got = sorted((r["score"], r["control_score"]) for r in pairs.collect())
    whole, settled = ca._nearest_pairs(left, 0.02)
    want = sorted((r["score"], r["control_score"]) for r in whole.collect())
    # brute force: the closest possible pair first, of equally close ones the lower
    t, c = ([s for _, w, s in rows if w == side] for side in (1, 0))
    brute = []
    while near := [(abs(a - b), min(a, b), a, b) for a in set(t) for b in set(c) if abs(a - b) <= 0.02]:
        _, _, a, b = min(near)
        brute.append((a, b))
        t.remove(a), c.remove(b)
    assert settled and want == sorted(brute)
    # small pieces pair no others
    assert len(set(got) - set(brute)) == 0 and len(got) > len(brute) // 2


def test_tree_fits_bound_what_a_task_keeps(spark, learnable, monkeypatch):
    """Partitions cut by shuffle or file size would hold all 1,500 rows; what a fit keeps of a row is many times that."""
    monkeypatch.setattr(mo, "TASK_BYTES", 20_000, raising=False)
    seen = {}

    def recording(kind):
        class Recorder(getattr(mo, kind)):
            def fit(self, dataset, params=None):
                seen[kind] = max(r["count"] for r in dataset.groupBy(F.spark_partition_id()).count().collect())
                return super().fit(dataset, params)

        return Recorder

    for kind in ("RandomForestClassifier", "GBTRegressor"):
        monkeypatch.setattr(mo, kind, recording(kind))
    rows = learnable.withColumn("label", F.col("purchase"))
    mo.mix_inference(rows, rows.drop("label"), "label", ["x"], ["g"], trees=10, depth=3)
    assert seen.pop("RandomForestClassifier") * (200 + 16 * 2 + 12 * 10) <= 25_000
    forest = mo.RandomForestClassifier(numTrees=5, maxDepth=2, seed=1)
    mo.train_conversion(learnable, SPEC, candidates={"forest": forest})
    assert seen["RandomForestClassifier"] * (200 + 12 * 5) <= 25_000
    mo.price_fit(learnable, "x", ["purchase"], ["g"], "gbt", key="order_id", trees=2, depth=2)
    assert seen["GBTRegressor"] * 200 <= 25_000
