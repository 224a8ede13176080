"""Conversion, price and mix models on MLlib: features, encoders, training, scoring."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from launchlens.functions.rules import DEPOSIT_RULES, map_contains
from launchlens.functions.semantics import age_band, interval_days
from launchlens.operators.boosting import BoostedModel, GBTRegressor, Layout
from launchlens.operators.buyers import buyer_history
from launchlens.operators.encoding import TargetFreqEncoder
from launchlens.operators.evaluation import auc, auc_by, class_report
from launchlens.operators.linear import Gram, LinearFit, cross_validated, design, grams, kept_rows, least_squares
from launchlens.operators.logistic import Member, aucs, fit as fit_many, prepare
from launchlens.operators.periods import any_period
from launchlens.operators.splits import in_share, numbered, stratified_split
from launchlens.plans.selection import exact_medians
from launchlens.plans.skew import first_row, ordinal, with_row
from launchlens.session import cut_lineage


def training_set(df: DataFrame, periods: DataFrame, deposit_rules: Sequence[tuple[str, float]] = DEPOSIT_RULES, key: str = "id") -> DataFrame:
    """Orders paid in any period, once each, with label and features.

    purchase, buyer history, days from touch / assign / presale start to payment (a
    presale gap before the start is null) and the deposit by group name.
    """
    orders = any_period(df.where(F.col("pay_time").isNotNull()), periods)
    # of the rows of one order and time the first by these decides
    ties = [F.col(c) for c in ("lock_time", "invoice_time", "refund_time", "grp", "buyer_id", "buyer_phone") if c in orders.columns]
    unique = first_row(orders, ["order_id"], [F.col("pay_time"), *ties])
    known = buyer_history(unique, key)
    starts = periods.select("grp", F.col("start_date").cast("timestamp").alias("_start"))
    gap = interval_days("_start", "pay_time", whole=False)
    out = known.join(starts, "grp", "left").withColumns(
        {
            "purchase": F.col("lock_time").isNotNull().cast("int"),
            "presale_gap_days": F.when(gap >= 0, gap),
            "deposit_amount": map_contains("grp", deposit_rules),
        }
    )
    for c, name in (("touch_time", "touch_to_pay_days"), ("assign_time", "assign_to_pay_days")):
        if c in df.columns:
            out = out.withColumn(name, interval_days(c, "pay_time", whole=False))
    return out.drop("_start")


def uniform(key: str, seed: int) -> Column:
    """A reproducible number in [0, 1) per row key, the same on every run and cluster."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_003)) / F.lit(1_000_003.0)


@dataclass
class FeatureSpec:
    numeric: Sequence[str] = ()
    categorical: Sequence[str] = ()
    encoded: Sequence[str] = ()


@dataclass
class ConversionModel:
    """An ML pipeline, target encoder included, with the names of its features."""

    pipeline: PipelineModel
    features: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds probability (of the positive class) and prediction."""
        scored = self.pipeline.transform(df).drop("_num", "_num_scaled", "features", "rawPrediction", "_w")
        return scored.withColumn("probability", vector_to_array("probability")[1])

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        spark.createDataFrame([(list(self.features),)], "features array<string>").write.mode("overwrite").json(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ConversionModel":
        names = spark.read.schema("features array<string>").json(f"{path}/features").first()["features"]
        return ConversionModel(PipelineModel.load(f"{path}/pipeline"), list(names or []))


def filled(medians: dict[str, float], more: Sequence[str] = ()) -> SQLTransformer:
    """Adds _x_<column>: the column as a double, its median where it is missing. Columns without any value are left out."""
    number = "CAST(`{c}` AS DOUBLE)"
    fills = [f"CASE WHEN {x} IS NULL OR isnan({x}) THEN CAST('{m!r}' AS DOUBLE) ELSE {x} END AS `_x_{c}`" for c, m in medians.items() for x in [number.format(c=c)]]
    return SQLTransformer(statement=f"SELECT {', '.join(['*', *fills, *more])} FROM __THIS__")


#: What the rows that one task of a tree fit keeps at hand may take.
TASK_BYTES = 64 << 20


def dealt(rows: DataFrame, n: int, n_features: int, trees: int = 1) -> DataFrame:
    """The `n` rows dealt evenly to so many tasks that what MLlib keeps of each task's rows stays under TASK_BYTES.

    Beside vector and bins MLlib keeps a weight and a node per row and tree, often twenty times what the row takes in a
    shuffle, so partitions cut by shuffle or file size hold far too much.
    """
    parts = -(-n * (200 + 16 * n_features + 12 * trees) // TASK_BYTES)
    return rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism))


@dataclass
class Prepared:
    """Fitted stages in front of a classifier, the features' names, and rows (label, features, _w), written once."""

    stages: list
    rows: DataFrame
    names: list[str]


def prepare_classes(train: DataFrame, label: str, spec: FeatureSpec, weighted: bool = True, trees: int = 1) -> Prepared:
    """Target encoding, median imputation, scaling, one-hot and balanced weights for models of up to so many trees."""
    encoder = TargetFreqEncoder(inputCols=list(spec.encoded), labelCol=label).fit(train) if spec.encoded else None
    made = [f"{c}_{s}" for s in ("te", "fe") for c in spec.encoded]
    ready = (encoder.transform(train) if encoder else train).select(label, *spec.numeric, *made, *spec.categorical)
    ready = cut_lineage(ready)  # every stage of the pipeline reads it again
    medians = exact_medians(ready, [*spec.numeric, *made])
    numeric = list(medians)
    n = ready.groupBy(label).agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in n)
    weight = F.lit(1.0)
    if weighted:
        weight = F.coalesce(*[F.when(F.col(label) == r[label], F.lit(total / (len(n) * r["n"]))) for r in n])
    stages = []
    if numeric:
        stages += [
            filled(medians),
            VectorAssembler(inputCols=[f"_x_{c}" for c in numeric], outputCol="_num"),
            StandardScaler(inputCol="_num", outputCol="_num_scaled", withMean=True, withStd=True),
        ]
    for c in spec.categorical:
        stages += [
            StringIndexer(inputCol=c, outputCol=f"_{c}_ix", handleInvalid="keep"),
            OneHotEncoder(inputCol=f"_{c}_ix", outputCol=f"_{c}_oh", dropLast=False),
        ]
    inputs = (["_num_scaled"] if numeric else []) + [f"_{c}_oh" for c in spec.categorical]
    fitted = Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features")]).fit(ready)
    names = list(numeric)
    indexers = [x for x in fitted.stages if isinstance(x, StringIndexerModel)]
    for c, ix in zip(spec.categorical, indexers):
        names += [f"{c}={v}" for v in [*ix.labels, "unseen"]]
    rows = fitted.transform(ready).select(label, "features", weight.alias("_w"))
    return Prepared(([encoder] if encoder else []) + fitted.stages, cut_lineage(dealt(rows, total, len(names), trees)), names)


def fit_classifier(train: DataFrame, label: str, spec: FeatureSpec, classifier, weighted: bool = True, prepared: Prepared | None = None) -> ConversionModel:
    """The classifier with balanced weights behind the stages of `prepare_classes`, all stages of one pipeline."""
    prepared = prepared or prepare_classes(train, label, spec, weighted, _trees(classifier))
    model = classifier.setLabelCol(label).setFeaturesCol("features").setWeightCol("_w").fit(prepared.rows)
    return ConversionModel(PipelineModel([*prepared.stages, model]), list(prepared.names))


def _trees(classifier) -> int:
    """Trees that grow at once."""
    return classifier.getNumTrees() if isinstance(classifier, RandomForestClassifier) else 1


def feature_weights(model: ConversionModel) -> list[tuple[str, float]]:
    """(feature, coefficient or importance), largest absolute value first."""
    last = model.pipeline.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    return sorted(zip(model.features, [float(v) for v in values.toArray()]), key=lambda t: (-abs(t[1]), t[0]))


def classifiers(n_rows: int, trees: int = 300, boost: int = 100, depth: int = 6, seed: int = 42) -> dict:
    """The candidate models. regParam 1/n is the usual unit ridge penalty on the summed loss."""
    return {
        "logistic": LogisticRegression(maxIter=200, regParam=1.0 / max(n_rows, 1), standardization=False),
        "forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed),
        "boosted": GBTClassifier(maxIter=boost, maxDepth=depth, stepSize=0.08, subsamplingRate=0.8, seed=seed),
    }


@dataclass
class Trained:
    best: str
    models: dict[str, ConversionModel]
    aucs: dict[str, float]
    scored: dict[str, DataFrame]
    label: str

    def report(self) -> DataFrame:
        """Per model its classification report, with the exact AUC and whether the model is the best."""
        out = None
        for name, scored in self.scored.items():
            part = class_report(scored, self.label).select(
                F.lit(name).alias("model"), F.lit(self.aucs[name]).alias("auc"), F.lit(name == self.best).alias("is_best"), "*"
            )
            out = part if out is None else out.unionByName(part)
        return out

    def weights(self, spark: SparkSession) -> DataFrame:
        rows = [(n, f, w) for n, m in self.models.items() for f, w in feature_weights(m)]
        return spark.createDataFrame(rows, "model string, feature string, weight double")


def train_conversion(
    df: DataFrame, spec: FeatureSpec, label: str = "purchase", key: str = "order_id", candidates: dict | None = None
) -> Trained:
    """Logistic, forest and boosted trees on an exactly stratified 80/20 split; the best by AUC on the held-out part."""
    rows = cut_lineage(df.select(key, label, *spec.numeric, *spec.categorical, *spec.encoded))
    train, test = (cut_lineage(part) for part in stratified_split(rows, key, label))
    candidates = candidates or classifiers(train.count())
    prepared = prepare_classes(train, label, spec, trees=max(_trees(c) for c in candidates.values()))
    models, aucs, scored = {}, {}, {}
    for name, c in candidates.items():
        models[name] = fit_classifier(train, label, spec, c, prepared=prepared)
        scored[name] = models[name].transform(test)
        aucs[name] = auc(scored[name], label)
    return Trained(max(aucs, key=aucs.get), models, aucs, scored, label)


def ablation(df: DataFrame, feature: str, spec: FeatureSpec, label: str = "purchase", key: str = "order_id", top: int = 15) -> DataFrame:
    """Held-out AUC without, only with and including one feature, and the largest coefficients of the full model.

    The three logistic models are fitted together over one exactly stratified split.
    """
    rows = numbered(df.select(key, label, feature, *spec.numeric, *spec.categorical, *spec.encoded), key, label)
    rows = rows.withColumns({"_fold": F.when(in_share(0.2), 0).otherwise(1), "_tier": F.lit(0)})
    made = [f"{c}_{s}" for c in spec.encoded for s in ("te", "fe")]
    base = (*spec.numeric, *spec.categorical, *made)
    models = {"base": base, "feature_only": (feature,), "full": None}
    many = prepare(rows, label, [*spec.numeric, feature], spec.categorical, spec.encoded, [Member(0, 0, uses) for uses in models.values()])
    found = aucs(fit_many(many))
    out = [("auc", name, float(found[(k, "valid")])) for k, name in enumerate(models)]
    weights = sorted(zip(many.names, many.weights[2][:-1].tolist()), key=lambda t: (-abs(t[1]), t[0]))
    out += [("coefficient", f, w) for f, w in weights[:top]] + [("feature_coefficient", f, w) for f, w in weights if f == feature]
    return df.sparkSession.createDataFrame(out, "section string, name string, value double")


def score_batch(model: ConversionModel, df: DataFrame, date: str, group: str) -> DataFrame:
    """Scores of the orders of one group paid on one date."""
    picked = df.where((F.to_date("pay_time") == F.lit(date).cast("date")) & (F.col("grp") == group))
    return model.transform(picked)


def mean_score(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("orders"), F.avg("probability").alias("mean_probability"))


def learning_curve(
    df: DataFrame, spec: FeatureSpec, label: str = "purchase", key: str = "order_id",
    sizes: Sequence[float] = tuple(0.1 + 0.9 * i / 7 for i in range(8)), folds: int = 3,
) -> DataFrame:
    """Train and validation AUC (mean, population std) per training share.

    Folds and the nested training parts are exactly stratified by the label. The logistic models of all sizes
    and folds are fitted together, one pass a step.
    """
    sizes = sorted(float(x) for x in sizes)
    rows = numbered(df.select(key, label, *spec.numeric, *spec.categorical, *spec.encoded), key, label)
    fold = (F.col("_place") % folds).cast("int")
    # rows of the same label and fold, and the place among them
    mates, place = F.ceil((F.col("_of") - fold) / F.lit(folds)), F.floor(F.col("_place") / folds)
    left_out = [F.when(place >= F.round(mates * F.lit(share)), 1).otherwise(0) for share in sizes]
    tier = left_out[0]
    for more in left_out[1:]:
        tier = tier + more
    members = [Member(k, s) for s in range(len(sizes)) for k in range(folds)]
    many = fit_many(prepare(rows.withColumns({"_fold": fold, "_tier": tier}), label, spec.numeric, spec.categorical, spec.encoded, members))
    found = aucs(many)
    out = []
    for s, share in enumerate(sizes):
        mine = [s * folds + k for k in range(folds)]
        parts = [np.array([found[(k, part)] for k in mine], float) for part in ("train", "valid")]
        stats = [float(f(x)) for x in parts for f in (np.mean, np.std)]
        out.append((share, float(many.sizes[mine].mean()), *stats, 1 - stats[0], 1 - stats[2]))
    names = "train_share double, train_size double, train_auc_mean double, train_auc_std double, val_auc_mean double, val_auc_std double, train_error double, val_error double"
    return df.sparkSession.createDataFrame(out, names)


# ---- price


@dataclass
class PriceFit:
    """A fitted price model, its held-out rows (_key, label, features as an array, for trees the words of their cells) and errors on them."""

    model: object
    names: list[str]
    test: DataFrame
    metrics: dict[str, float]
    held: Gram | None = None

    def table(self, spark: SparkSession) -> DataFrame:
        values = self.model.coefficients if isinstance(self.model, LinearFit) else self.model.featureImportances.toArray()
        rows = [("metric", k, float(v)) for k, v in self.metrics.items()]
        pairs = sorted(zip(self.names, [float(v) for v in values]), key=lambda t: (-abs(t[1]), t[0]))
        return spark.createDataFrame(rows + [("feature", n, v) for n, v in pairs], "section string, name string, value double")

    def predicted(self, rows: DataFrame) -> DataFrame:
        """Adds prediction to rows with an array of features."""
        if isinstance(self.model, LinearFit):
            return rows.withColumn("prediction", self.model.predict("features"))
        return self.model.transform(rows)

    def scored(self) -> DataFrame:
        """The held-out rows with prediction."""
        return self.model.scored(self.test) if isinstance(self.model, BoostedModel) else self.predicted(self.test)


def price_fit(
    df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], kind: str = "ols", key: str = "id",
    min_support: float = 0.03, alphas: Sequence[float] | None = None, folds: int = 5, trees: int = 400, depth: int = 6,
    pairs: DataFrame | None = None, held_out: Column | None = None,
) -> PriceFit:
    """ols, lasso, ridge (k-fold over a grid of penalties) or gbt, and its errors on held-out rows.

    Features are median-filled numerics, the one-hot values with enough support and, with `pairs` (from
    `interactions`), products of two of those. `held_out` marks the rows that measure the model; by default
    one in five by a hash of the key. Linear models come from one pass over the encoded rows that sums
    a Gram per fold; penalties are on the summed squares (ridge) or, for half the mean squared
    error, on the summed sizes (lasso).
    """
    if kind not in ("ols", "lasso", "ridge", "gbt"):
        raise ValueError(f"unknown kind {kind!r}")
    shape = design(df, target, numeric, categorical, min_support, pairs)
    held = held_out if held_out is not None else uniform(key, 42) < 0.2
    rows = kept_rows(df, shape, target, key, held, folds)
    test = rows.where("_fold = 0").select("_key", "label", shape.features().alias("features"))
    if kind == "gbt":
        train = rows.where("_fold > 0")
        layout = Layout.of(train, shape)
        cells = cut_lineage(layout.counted(train))
        cells = dealt(cells, cells.count(), len(shape.names))
        model = GBTRegressor(layout, maxIter=trees, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, seed=42).fit(cells)
        test = rows.where("_fold = 0").select("_key", "label", shape.features().alias("features"), *layout.cell())
        fit, found = PriceFit(model, shape.names, test, {}), None
    else:
        test_gram, *parts = grams(rows, shape, F.col("_fold"), folds + 1)
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        if kind == "ols":
            w, found = least_squares(total), None
        else:
            grid = alphas or ([10 ** (-4 + 5 * i / 19) for i in range(20)] if kind == "lasso" else [10 ** (-4 + 7 * i / 29) for i in range(30)])
            w, found = cross_validated(total, parts, kind, grid)
        fit = PriceFit(LinearFit(w, total.intercept(w)), shape.names, test, {}, test_gram)
    error = F.col("prediction") - F.col("label")
    seen = fit.scored().agg(F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.var_pop("label").alias("var")).first()
    mse = seen["mse"] if seen["mse"] is not None else float("nan")
    fit.metrics |= {"r2": 1 - mse / seen["var"] if seen["var"] else 0.0, "mae": seen["mae"] if seen["mae"] is not None else float("nan"), "rmse": mse**0.5}
    if found is not None:
        fit.metrics["penalty"] = found
    return fit


def perm_importance(fit: PriceFit, features: Sequence[str] | None = None, piece_rows: int = 100_000) -> DataFrame:
    """Rise of the root mean squared error on the held-out rows when one feature's values are dealt to other rows.

    A linear model needs no scoring: the expected error over all permutations follows from its Gram. For
    trees the rows are numbered in the order of a keyed hash, in pieces of about `piece_rows`, and each takes
    its values from the row half a round further. Rows that then agree in all bins and flags are one cell, with a
    count and sums of the labels per permuted feature, and one job scores every such cell once.
    """
    spark = fit.test.sparkSession
    chosen = [i for i, name in enumerate(fit.names) if features is None or name in features]
    schema = "feature string, rise double"
    if fit.held is not None:
        rises = np.sqrt(np.maximum(fit.model.permuted_mse(fit.held), 0.0)) - fit.model.mse(fit.held) ** 0.5
        return spark.createDataFrame([(fit.names[i], float(rises[i])) for i in chosen], schema)
    n = fit.test.count()
    if not n or not chosen:
        return spark.createDataFrame([], schema)
    layout = fit.model.layout
    words, n_numeric, n_values = layout.words, len(layout.cuts), sum(map(len, layout.columns))
    h = F.xxhash64(F.lit("deal"), "_key")
    piece = F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * F.lit(-(-n // piece_rows)))
    cells = fit.test.select("_key", (F.col("label") - F.lit(layout.label_at)).alias("_y"), *words, h.alias("_h"))
    numbered = cut_lineage(ordinal(cells, [], [F.col("_h"), F.col("_key")], piece, "_pos").select("_y", "_pos", *words))
    donors = numbered.select(((F.col("_pos") + max(n // 2, 1)) % n).alias("_at"), *[F.col(w).alias(f"_d{w}") for w in words])
    pairs = numbered.withColumn("_at", F.col("_pos") % n).join(donors, "_at")

    def swapped(i: int) -> Column:
        """The cell with the donor's value of feature i (-1: none), and the place of a flag that so has turned over, or -1."""
        cell, turned = {w: F.col(w) for w in words}, F.lit(-1)
        if 0 <= i < n_numeric:
            word, size = layout.places[i]
            cell[words[word]] += (layout.number(i, "_d") - layout.number(i)) * F.lit(size)
        elif i >= 0:
            values = layout.pairs[i - n_numeric - n_values] if i >= n_numeric + n_values else (i - n_numeric,)
            own, theirs = (functools.reduce(Column.__and__, [layout.flag(v, side) for v in values]) for side in ("", "_d"))
            turned = F.when(own != theirs, F.lit(i)).otherwise(turned)
        return F.struct(F.lit(i).alias("_i"), turned.alias("_turned"), *[c.alias(w) for w, c in cell.items()])

    each = pairs.select("_y", F.inline(F.array(*[swapped(i) for i in (-1, *chosen)])))
    sums = each.groupBy("_turned", *words, "_i").agg(F.count("*").alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q"))
    met = sums.groupBy(*words, "_turned").agg(F.collect_list(F.struct("_i", "n", "s", "q")).alias("_sums"))
    scored = fit.model.cells(met, toggled="_turned").select((F.col("prediction") - F.lit(layout.label_at)).alias("_p"), F.inline("_sums"))
    error = F.col("n") * F.col("_p") * F.col("_p") - F.lit(2.0) * F.col("_p") * F.col("s") + F.col("q")
    rmse = scored.groupBy("_i").agg(F.sqrt(F.greatest(F.sum(error) / F.sum("n"), F.lit(0.0))).alias("rmse"))
    rmse = cut_lineage(rmse)
    base = rmse.where("_i < 0").select(F.col("rmse").alias("base"))
    named = F.get(F.array(*[F.lit(name) for name in fit.names]), F.col("_i"))
    return with_row(rmse.where("_i >= 0"), base).select(named.alias("feature"), (F.col("rmse") - F.col("base")).alias("rise"))


# ---- mix inference


@dataclass
class Mix:
    """Shares among unlabeled orders, the scored orders, and how the forest did on held-out labeled ones."""

    result: DataFrame
    scored: DataFrame
    report: DataFrame
    importances: DataFrame


def mix_inference(
    labeled: DataFrame, everything: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], key: str = "order_id",
    trees: int = 100, depth: int = 30, test_share: float = 0.3,
) -> Mix:
    """Type shares among unlabeled orders from a labeled subset.

    The forest learns from an exactly stratified part of the labeled orders and is measured on the rest: `report` is its
    classification report with the exact AUC, `importances` has one row per feature. `result` has one row:
    probabilities are pulled towards the labeled mean by a factor max(0.5, 1 - 0.1 d), d being the distance of the
    standardised feature means of all and labeled orders. Every order is scored once.
    """
    spark = labeled.sparkSession
    keep = [*numeric, *categorical]
    both = labeled.select(*keep).unionByName(everything.select(*keep))
    medians = exact_medians(both, numeric)
    num = [f"_x_{c}" for c in medians]
    stages = [filled(medians, [f"coalesce(CAST(`{c}` AS STRING), 'Unknown') AS `_s_{c}`" for c in categorical])]
    for c in categorical:
        stages.append(StringIndexer(inputCol=f"_s_{c}", outputCol=f"_ix_{c}", stringOrderType="alphabetAsc", handleInvalid="keep"))
    inputs = num + [f"_ix_{c}" for c in categorical]
    # scaling leaves plain numbers, so the forest splits the codes by order
    stages += [VectorAssembler(inputCols=inputs, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)]
    prep = Pipeline(stages=stages).fit(both)
    tmp = ["_raw", *num, *[f"_s_{c}" for c in categorical], *[f"_ix_{c}" for c in categorical]]
    lab = cut_lineage(numbered(prep.transform(labeled).drop(*tmp), key, label))
    train, test = (lab.where(cond).drop("_place", "_of") for cond in (~in_share(test_share), in_share(test_share)))
    spread = dealt(train.select(label, "features"), train.count(), len(inputs), trees)
    # deep trees pass their nodes by id over the rows
    forest = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, maxBins=128, cacheNodeIds=True, seed=42).fit(spread)
    chance = lambda rows: forest.transform(rows).withColumn("probability", vector_to_array("probability")[1]).drop("rawPrediction")
    held = cut_lineage(chance(test).select(F.col(label), "probability"))
    report = with_row(class_report(held, label), auc_by(held, label).select("auc"))
    gains = [(c, float(v)) for c, v in zip([*medians, *categorical], forest.featureImportances.toArray())]
    importances = spark.createDataFrame(sorted(gains, key=lambda t: (-t[1], t[0])), "feature string, importance double")
    scored = cut_lineage(chance(prep.transform(everything).drop(*tmp)))
    m_all = scored.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"]
    m_lab = lab.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"]
    distance = float(m_all.squared_distance(m_lab)) ** 0.5
    factor = max(0.5, 1.0 - 0.1 * distance)
    known = lab.agg(F.avg(label).alias("y"), F.count("*").alias("n")).first()
    share = F.avg("probability") * factor + (1 - factor) * known["y"]
    result = scored.agg(F.count("*").alias("orders"), share.alias("share")).select(
        "orders", "share", (1 - F.col("share")).alias("other_share"),
        F.floor(F.col("share") * F.col("orders")).alias("estimated_orders"),
        F.floor((1 - F.col("share")) * F.col("orders")).alias("estimated_other_orders"),
        F.lit(factor).alias("calibration_factor"), (F.lit(float(known["n"])) / F.col("orders")).alias("labeled_ratio"),
    )
    return Mix(result, scored.drop("features"), report, importances)


def mix_segments(scored: DataFrame, min_region: int = 50) -> DataFrame:
    """Mean probability and orders by gender, region (with enough orders) and age band."""
    dims = {"gender": F.col("gender"), "region": F.col("region"), "age": age_band("age", "segments")}
    structs = [F.struct(F.lit(k).alias("segment"), v.cast("string").alias("value")) for k, v in dims.items()]
    rows = scored.select("probability", F.inline(F.array(*structs))).where(F.col("value").isNotNull())
    out = rows.groupBy("segment", "value").agg(F.avg("probability").alias("mean_probability"), F.count("probability").alias("orders"))
    return out.where((F.col("segment") != "region") | (F.col("orders") >= min_region))
