"""Exactly stratified splits and folds by distributed numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from launchlens.plans.skew import join_null_safe, ordinal
from launchlens.session import cut_lineage


def numbered(df: DataFrame, key: str, label: str, seed: int = 42, piece_rows: int = 100_000) -> DataFrame:
    """Adds _place, from 0 inside each label in the order of a keyed hash, and _of, the rows of the label.

    The numbering is the same on every cluster. It works in hash ranges of about `piece_rows` rows, so no task
    orders a label. Rows that share a key are numbered in any order. `df` is computed once.
    """
    df = cut_lineage(df)
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_of"))
    n = sizes.agg(F.sum("_of")).first()[0] or 0
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    piece = F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * F.lit(max(-(-n // piece_rows), 1)))
    placed = ordinal(hashed.withColumn("_label", F.col(label)), ["_label"], [F.col("_h"), F.col(key)], piece, "_place")
    out = join_null_safe(placed, sizes, ["_label"])
    return out.select(*df.columns, (F.col("_place") - 1).alias("_place"), "_of")


def in_share(share: float) -> Column:
    """Whether a numbered row is among the first `share` of its label, rounded to whole rows."""
    return F.col("_place") < F.round(F.col("_of") * F.lit(float(share)))


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): of each label exactly `test_share`, rounded to whole rows, is in test."""
    rows = numbered(df, key, label, seed)
    return rows.where(~in_share(test_share)).drop("_place", "_of"), rows.where(in_share(test_share)).drop("_place", "_of")
