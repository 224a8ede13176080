"""Exact order statistics by radix selection over counted values.

A group's values are counted once. The wanted ranks are then found digit by digit: count the rows
per (group, leading bits of the value's logarithm), find the bucket that holds a rank by prefix
sums, and descend into that bucket only. What one task orders is the digits of one
level, a few million rows at most, however many values a group has.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from launchlens.plans.skew import join_null_safe
from launchlens.session import cut_lineage

#: Bits after the point of a value's logarithm that the first and the second digit have.
FIRST, SECOND = 10, 31


def digit(value: Column, bits: int = FIRST) -> Column:
    """A long that does not fall as doubles rise: the sign, and the logarithm to `bits` bits after the point.

    It has fewer than 2 ** (bits + 12) different values, and a digit of more bits refines one of fewer. Infinite
    values share the digit of the largest ones; NaN is greatest.
    """
    v = value.cast("double")
    size = F.least(F.abs(v), F.lit(sys.float_info.max))
    # above 0 for the smallest double; the logarithm of 0 is null
    place = F.signum(v) * F.coalesce(F.ln(size) * F.lit(1 / math.log(2)) + F.lit(1100.0), F.lit(0.0))
    return F.floor(F.when(F.isnan(v), F.lit(4000.0)).otherwise(place) * F.lit(2.0**bits))


def value_counts(df: DataFrame, by: Sequence[str], value: str | Column) -> DataFrame:
    """(by..., v, n): every value of every group with its number of rows, null values too. The one read of the source."""
    v = F.col(value) if isinstance(value, str) else value
    return cut_lineage(df.select(*by, v.cast("double").alias("v")).groupBy(*by, "v").agg(F.count("*").alias("n")))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None) -> DataFrame:
    """Linearly interpolated exact quantiles per group as columns q0, q1, ... (one per prob).

    `weight` names a column of whole row counts; the caller has counted the values then. Null
    values and groups without others are left out.
    """
    if weight is None:
        df, value, weight = value_counts(df, by, value), "v", "n"
    keys = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    key_cols = [F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("_k0")]
    rows = df.select(*key_cols, F.col(value).cast("double").alias("_v"), F.col(weight).cast("long").alias("_c")).where(F.col("_v").isNotNull())
    rows = rows.withColumns({"_d0": digit(F.col("_v")), "_d1": digit(F.col("_v"), SECOND)})
    # each quantile lies between the values at two ranks
    h = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array(*[F.struct(F.lit(2 * i + up).alias("i"), (F.ceil(x) if up else F.floor(x)).alias("r")) for i, x in enumerate(h) for up in (0, 1)])
    counted = rows.groupBy(*keys, "_d0").agg(F.sum("_c").alias("_c"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_d0").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumns({"_to": F.sum("_c").over(upto), "_n": F.sum("_c").over(group)}).withColumn("_t", F.explode(ranks))
    found = _hit(placed.select(*keys, "_d0", "_n", F.col("_t.i").alias("_i"), F.col("_t.r").alias("_r"), "_c", "_to"), [*keys, "_d0", "_n"])
    path = [*keys, "_d0"]
    # values that share two digits are told apart by themselves
    for step in ("_d1", "_v"):
        inside = join_null_safe(rows.select(*path, step, "_c"), found.select(*path, "_n", "_i", "_r"), path)
        counted = inside.groupBy(*path, "_n", "_i", "_r", step).agg(F.sum("_c").alias("_c"))
        upto = Window.partitionBy(*keys, "_i").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
        found = _hit(counted.withColumn("_to", F.sum("_c").over(upto)), [*path, step, "_n"])
        path.append(step)
    out = found.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(f"_r{i}") for i in range(2 * len(probs))])
    part = [x - F.floor(x) for x in h]
    return out.select(
        *[F.col(k).alias(c) for k, c in zip(keys, by)],
        *[(F.when(p > 0, F.col(f"_r{2 * i}") + (F.col(f"_r{2 * i + 1}") - F.col(f"_r{2 * i}")) * p).otherwise(F.col(f"_r{2 * i}"))).alias(f"q{i}") for i, p in enumerate(part)],
    )


def _hit(counted: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The bucket that holds each rank, and the rank inside it."""
    before = F.col("_to") - F.col("_c")
    return counted.where((before <= F.col("_r")) & (F.col("_r") < F.col("_to"))).select(*keep, "_i", (F.col("_r") - before).alias("_r"))


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Median of every column that has a value that is a number; one row per column reaches the driver."""
    if not columns:
        return {}
    structs = [F.struct(F.lit(c).alias("_column"), F.col(f"`{c}`").cast("double").alias("_x")) for c in columns]
    long = df.select(F.inline(F.array(*structs))).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    found = {row["_column"]: row["q0"] for row in exact_quantiles(long, ["_column"], "_x", [0.5]).collect()}
    return {c: found[c] for c in columns if c in found}


def counted_moments(counts: DataFrame, by: Sequence[str], value: str = "v", n: str = "n") -> DataFrame:
    """(by..., rows, count, mean, std, std_samp, min, max) from counted values; squares are of distances from the mean.

    rows counts null values too. std is the population form, std_samp the sample form, null for one value.
    """
    v, c = F.col(value).cast("double"), F.col(n)
    known = F.sum(F.when(v.isNotNull(), c))
    first = counts.groupBy(*by).agg(F.sum(c).alias("rows"), F.coalesce(known, F.lit(0)).alias("count"), (F.sum(v * c) / known).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    keys = [F.col(b).alias(f"_k{i}") for i, b in enumerate(by)] or [F.lit(0).alias("_k0")]
    names = [f"_k{i}" for i in range(max(len(by), 1))]
    centred = join_null_safe(counts.select(*keys, v.alias("_v"), c.alias("_c")), first.select(*keys, F.col("mean").alias("_m")), names)
    squares = centred.groupBy(*names).agg(F.sum((F.col("_v") - F.col("_m")) * (F.col("_v") - F.col("_m")) * F.col("_c")).alias("_ss"))
    out = join_null_safe(first.select(*keys, *[x for x in first.columns if x not in by]), squares, names)
    return out.select(
        *[F.col(k).alias(b) for k, b in zip(names, by)],
        "rows",
        "count",
        "mean",
        F.sqrt(F.try_divide(F.col("_ss"), F.col("count").cast("double"))).alias("std"),
        F.sqrt(F.try_divide(F.col("_ss"), (F.col("count") - 1).cast("double"))).alias("std_samp"),
        "min",
        "max",
    )


def count_stats(counts: DataFrame, by: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """Descriptive statistics from (value, count) rows, quartiles exact.

    std is the population form, std_samp the sample form (0 for one row). Groups without a value are left out.
    """
    counts = cut_lineage(counts.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), F.col(n).alias("n")))
    moments = counted_moments(counts, by).withColumn("std_samp", F.coalesce("std_samp", F.lit(0.0)))
    quartiles = exact_quantiles(counts, by, "v", [0.25, 0.5, 0.75], weight="n").toDF(*by, "q25", "median", "q75")
    return join_groups(moments, quartiles, by).select(*by, "count", "mean", "median", "std", "std_samp", "min", "max", "q25", "q75")


def join_groups(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two tables with one row per group side by side, null groups meeting each other."""
    if not by:
        return a.join(b, F.lit(True))
    renamed = b.toDF(*[f"_r_{c}" if c in by else c for c in b.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return a.join(renamed, cond).drop(*[f"_r_{c}" for c in by])
