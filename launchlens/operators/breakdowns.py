"""Locks and refunds by attribute, one aggregation for all launches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from launchlens.functions.rules import product_category
from launchlens.functions.semantics import count_if, day_index, plus_days, ratio
from launchlens.operators.buyers import buyer_key
from launchlens.operators.curves import rate_class
from launchlens.operators.filters import price_lookup
from launchlens.operators.periods import group_period
from launchlens.plans.selection import count_stats, exact_quantiles
from launchlens.plans.skew import first_row
from launchlens.session import cut_lineage


@dataclass(frozen=True)
class LockSpec:
    """Conditions shared by all lock breakdowns; unset ones do not filter."""

    groups: Sequence[str] = ()
    pay: tuple[str, str] | None = None
    lock: tuple[str, str] | None = None
    lock_n: int | None = None
    lock_cutoff: str = "end_plus_n"  # or start_plus_k
    cutoff_base_days: int = 30
    categories: Sequence[str] = ()
    day_kind: str = "all"  # all, weekend, weekday
    repeat_mode: str = "keep"  # keep, single_only, first_order
    repeat_key: str = "id"
    city_levels: Sequence[str] = ()


def lock_slice(df: DataFrame, periods: DataFrame, spec: LockSpec) -> DataFrame:
    """Locked orders under a LockSpec. A cutoff drops groups without a period."""
    out = df.where(F.col("grp").isin(list(spec.groups))) if spec.groups else df
    for col, rng in (("pay_time", spec.pay), ("lock_time", spec.lock)):
        if rng:
            out = out.where((F.col(col) >= F.lit(rng[0]).cast("timestamp")) & (F.col(col) <= F.lit(rng[1]).cast("timestamp")))
    if spec.lock_n is not None:
        out = group_period(out, periods)
        if spec.lock_cutoff == "end_plus_n":
            out = out.where(F.col("lock_time") <= plus_days("end_date", spec.lock_n))
        elif spec.lock_cutoff == "start_plus_k":
            out = out.where(day_index("lock_time", "start_date") <= spec.cutoff_base_days + spec.lock_n)
        else:
            raise ValueError(f"unknown lock_cutoff {spec.lock_cutoff!r}")
        out = out.drop("start_date", "end_date")
    if spec.categories:
        out = out.where(product_category(F.coalesce(F.col("product"), F.lit("-"))).isin(list(spec.categories)))
    if spec.day_kind != "all":
        weekend = F.dayofweek("lock_time").isin(1, 7)
        out = out.where(weekend if spec.day_kind == "weekend" else ~weekend)
    if spec.repeat_mode == "single_only":
        key = out.withColumn("_k", buyer_key(spec.repeat_key))
        single = key.groupBy("_k").agg(F.count("*").alias("n")).where(F.col("_k").isNotNull() & (F.col("n") == 1))
        out = key.join(single, "_k", "left_semi").drop("_k")
    elif spec.repeat_mode == "first_order":
        key = out.withColumn("_k", buyer_key(spec.repeat_key))
        kept = first_row(key.where(F.col("_k").isNotNull()), ["_k"], [F.col("pay_time"), F.col("order_id")])
        out = kept.unionByName(key.where(F.col("_k").isNull())).drop("_k")
    if spec.city_levels:
        out = out.where(F.col("city_level").isin(list(spec.city_levels)))
    return out.where(F.col("lock_time").isNotNull())


def lock_by_dim(locked: DataFrame, dim: Column, name: str, keep_null: bool = False) -> DataFrame:
    """Locks and share per (value, group); the share's denominator counts all rows of the group, nulls too."""
    counts = locked.groupBy("grp", dim.alias(name)).agg(F.count("*").alias("locks"))
    shared = counts.withColumn("share_pct", ratio(F.col("locks"), F.sum("locks").over(Window.partitionBy("grp"))) * 100)
    return shared if keep_null else shared.where(F.col(name).isNotNull())


def lock_wide(shares: DataFrame, name: str, groups: Sequence[str], lo: int | None = None, hi: int | None = None) -> DataFrame:
    """One row per value, locks and share per group (0 where none).

    With bounds a value stays if the locks of any group lie inside them.
    """
    cols = []
    for g in groups:
        hit = F.col("grp") == g
        cols.append(F.coalesce(F.sum(F.when(hit, F.col("locks"))), F.lit(0)).alias(f"{g}_locks"))
        cols.append(F.coalesce(F.sum(F.when(hit, F.col("share_pct"))), F.lit(0.0)).alias(f"{g}_share_pct"))
    out = shares.where(F.col("grp").isin(list(groups))).groupBy(name).agg(*cols)
    if lo is not None and hi is not None:
        out = out.where(reduce(lambda a, b: a | b, [F.col(f"{g}_locks").between(lo, hi) for g in groups]))
    return out


def lock_by_product(locked: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Locks and share per group and product, with category and list price."""
    out = lock_by_dim(locked, F.col("product"), "product").withColumn("category", product_category("product"))
    return price_lookup(out, prices) if prices is not None else out


def row_max_flag(df: DataFrame, cols: Sequence[str], unique: bool = True, out: str = "max_column") -> DataFrame:
    """Name of the column holding the row's maximum; null when tied (if unique) or when nothing is above 0."""
    top = F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])
    ties = sum((F.when(F.col(c) == top, 1).otherwise(0) for c in cols), F.lit(0))
    name = F.coalesce(*[F.when(F.col(c) == top, F.lit(c)) for c in cols])
    ok = top > 0
    return df.withColumn(out, F.when(ok & (ties == 1) if unique else ok, name))


def refund_by_dim(
    df: DataFrame, periods: DataFrame, dim: str, n: int = 30, lo: int | None = None, hi: int | None = None
) -> DataFrame:
    """Orders paid by start+n, those refunded by then, and the rate with a class, per group and value.

    With bounds only values whose orders over all groups lie inside them are kept.
    """
    cutoff = plus_days("start_date", n)
    counts = (
        group_period(df, periods)
        .where((F.col("pay_time") <= cutoff) & F.col(dim).isNotNull())
        .groupBy("grp", F.col(dim).alias("value"))
        .agg(F.count("*").alias("orders"), count_if(F.col("refund_time") <= cutoff).alias("refunds"))
    )
    rate = ratio(F.col("refunds"), F.col("orders")) * 100
    out = counts.withColumn("refund_rate_pct", rate).withColumn("rate_class", rate_class(F.bround(rate, 2), 5, 10))
    if lo is not None and hi is not None:
        out = out.withColumn("_total", F.sum("orders").over(Window.partitionBy("value")))
        out = out.where(F.col("_total").between(lo, hi)).drop("_total")
    return out


def robust_stats(df: DataFrame, col: str, by: Sequence[str], lo: float = 15, hi: float = 85) -> DataFrame:
    """Mean, median, sample std, n and removed n after clamping to [lo, hi] and 1.5 IQR.

    Values are counted in one read; quartiles are selected from the counts, however many values there are.
    """
    counts = cut_lineage(df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("v")).agg(F.count("*").alias("n")))
    raw = counts.groupBy(*by).agg(F.sum("n").alias("raw_n"))
    clamped = counts.where(F.col("v").between(lo, hi))
    q = exact_quantiles(clamped, by, "v", [0.25, 0.75], weight="n").toDF(*by, "_q1", "_q3")
    iqr = F.col("_q3") - F.col("_q1")
    inside = clamped.join(q, list(by)).where(
        (F.col("v") >= F.col("_q1") - 1.5 * iqr) & (F.col("v") <= F.col("_q3") + 1.5 * iqr)
    )
    stats = count_stats(inside.select(*by, "v", "n"), by, "v").join(raw, list(by))
    return stats.select(
        *by, "mean", "median", "std_samp", F.col("count").alias("n"), (F.col("raw_n") - F.col("count")).alias("removed")
    )
