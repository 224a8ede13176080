"""Exact measures of scored rows: area under the ROC curve, and the classification report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from launchlens.functions.semantics import ratio
from launchlens.plans.selection import digit


def score_counts(scored: DataFrame, label: str, by: Sequence[str] = (), score: str = "probability") -> DataFrame:
    """(by..., score, pos, neg): rows of each different score. Rows without a label or score are left out."""
    rows = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    y = F.col(label).cast("double") > 0.5
    return rows.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))


def auc_by(scored: DataFrame, label: str, by: Sequence[str] = (), score: str = "probability") -> DataFrame:
    """(by..., pos, neg, auc) with the exact area under the ROC curve, null where a group has one kind of label.

    The area is the share of (positive, negative) pairs in the right order, ties counting one half: a rank sum over counted
    scores. Scores are cut into ranges by the leading bits of their logarithm; the negatives below a score are those of the
    ranges below, and those below it in its own range, so no task orders all the scores of a group.
    """
    keys = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    key_cols = [F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("_g0")]
    counts = score_counts(scored, label, by, score).select(*key_cols, "score", "pos", "neg")
    placed = counts.withColumn("_range", digit(F.col("score")))
    inside = Window.partitionBy(*keys, "_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    half = F.col("neg") / F.lit(2.0)
    local = placed.withColumn("_below", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    ranges = local.groupBy(*keys, "_range").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (F.col("_below") + half)).alias("_won")
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("_won") + F.col("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0))
    out = ranges.withColumn("_all", won).groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("_all").alias("_won"))
    area = F.try_divide(F.col("_won"), F.col("pos").cast("double") * F.col("neg"))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "pos", "neg", area.alias("auc"))


def auc(scored: DataFrame, label: str, score: str = "probability") -> float:
    """The exact area as a number; one half where only one kind of label is present."""
    row = auc_by(scored, label, score=score).first()
    return row["auc"] if row is not None and row["auc"] is not None else 0.5


def class_report(scored: DataFrame, label: str, cut: float | Column = 0.5, by: Sequence[str] = (), score: str = "probability") -> DataFrame:
    """Per class, and as accuracy, macro and weighted averages: hits, false_hits, missed, precision, recall, f1 and support.

    A row counts as 1 from `cut` on. Measures without a denominator are 0. The line 'accuracy' has its value in all three
    measures; averages have no counts of their own but the support.
    """
    y, hit = F.col(label).cast("double") > 0.5, F.col(score) >= cut
    rows = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    cells = {"_tp": y & hit, "_fp": ~y & hit, "_fn": y & ~hit, "_tn": ~y & ~hit}
    c = rows.groupBy(*by).agg(*[F.count_if(e).alias(n) for n, e in cells.items()])

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(ratio(a, b), F.lit(0.0))

    def measures(tp: str, fp: str, fn: str) -> tuple[Column, Column, Column]:
        precision, recall = share(F.col(tp), F.col(tp) + F.col(fp)), share(F.col(tp), F.col(tp) + F.col(fn))
        return precision, recall, share(precision * recall * 2, precision + recall)

    kinds = {"0": ("_tn", "_fn", "_fp"), "1": ("_tp", "_fp", "_fn")}
    per = {k: measures(*names) for k, names in kinds.items()}
    size = {k: F.col(names[0]) + F.col(names[2]) for k, names in kinds.items()}
    total = size["0"] + size["1"]
    none = F.lit(None).cast("long")

    def line(name: str, counts: Sequence[Column], values: Sequence[Column], support: Column) -> Column:
        named = zip(("hits", "false_hits", "missed", "precision", "recall", "f1", "support"), (*counts, *values, support))
        return F.struct(F.lit(name).alias("label"), *[v.alias(n) for n, v in named])

    lines = [line(k, [F.col(n) for n in names], per[k], size[k]) for k, names in kinds.items()]
    lines.append(line("accuracy", [none] * 3, [share(F.col("_tp") + F.col("_tn"), total)] * 3, total))
    lines.append(line("macro avg", [none] * 3, [(per["0"][i] + per["1"][i]) / 2 for i in range(3)], total))
    lines.append(line("weighted avg", [none] * 3, [share(per["0"][i] * size["0"] + per["1"][i] * size["1"], total) for i in range(3)], total))
    return c.select(*by, F.inline(F.array(*lines)))
