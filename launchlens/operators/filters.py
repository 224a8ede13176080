"""Row filters: sample filter, filter funnel, identity quality, derived product columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from launchlens.functions.rules import id_valid, product_category
from launchlens.functions.semantics import count_if, ratio
from launchlens.operators.buyers import buyer_key, repeat_buyers


@dataclass(frozen=True)
class SampleSpec:
    """All conditions of a sample; unset ones do not filter. Date ranges compare with midnight of both ends."""

    pay: tuple[str, str] | None = None
    refund: tuple[str, str] | None = None
    create: tuple[str, str] | None = None
    lock: tuple[str, str] | None = None
    categories: Sequence[str] = ()
    regions: Sequence[str] = ()
    groups: Sequence[str] = ()
    attr_classes: Sequence[str] = ()
    refund_only: bool = False
    locked_only: bool = False
    exclude_refund: bool = False
    exclude_locked: bool = False
    valid_id_only: bool = False
    repeat_only: bool = False
    exclude_repeat: bool = False
    category_tokens: Sequence[str] = field(default=("52", "66"))


def _between(col: str, rng: tuple[str, str] | None) -> Column:
    if rng is None:
        return F.lit(True)
    return (F.col(col) >= F.lit(rng[0]).cast("timestamp")) & (F.col(col) <= F.lit(rng[1]).cast("timestamp"))


def sample_filter(df: DataFrame, spec: SampleSpec, attr_map: DataFrame | None = None) -> DataFrame:
    """Conjunction of all set conditions; repeat buyers are found on the unfiltered table."""
    cond = _between("pay_time", spec.pay) & _between("refund_time", spec.refund) & _between("lock_time", spec.lock)
    if spec.create:
        cond = cond & _between("create_time", spec.create)
    if spec.categories:
        named = F.coalesce(F.col("product"), F.lit("-"))
        cond = cond & product_category(named, spec.category_tokens).isin(list(spec.categories))
    if spec.regions:
        cond = cond & F.col("region").isin(list(spec.regions))
    if spec.groups:
        cond = cond & F.col("grp").isin(list(spec.groups))
    if spec.refund_only:
        cond = cond & F.col("refund_time").isNotNull()
    if spec.locked_only:
        cond = cond & F.col("lock_time").isNotNull()
    if spec.exclude_refund:
        cond = cond & F.col("refund_time").isNull()
    if spec.exclude_locked:
        cond = cond & F.col("lock_time").isNull()
    if spec.valid_id_only:
        cond = cond & id_valid("buyer_id")
    if spec.repeat_only and spec.exclude_repeat:
        cond = F.lit(False)
    out = df.where(cond)
    if spec.attr_classes and attr_map is not None:
        wanted = attr_map.where(F.col("attr").isin(list(spec.attr_classes))).select(F.col("product").alias("_p")).distinct()
        out = out.join(wanted, F.col("product") == F.col("_p"), "left_semi")
    if spec.repeat_only != spec.exclude_repeat:
        ref = (spec.lock or spec.pay or (None, None))[0]
        keys = repeat_buyers(df, ref).select(F.col("buyer_key").alias("_k"))
        how = "left_semi" if spec.repeat_only else "left_anti"
        # rows without a buyer match no key; they are spread over their payment times instead of meeting on null
        spread = F.concat(F.lit("\0"), F.xxhash64("pay_time").cast("string"))
        out = out.withColumn("_k", F.coalesce(buyer_key().cast("string"), spread)).join(keys.select(F.col("_k").cast("string")), "_k", how).drop("_k")
    return out


def filter_funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each step of a chain of conditions, counted in one pass."""
    so_far, counts = F.lit(True), []
    for name, cond in steps:
        so_far = so_far & F.coalesce(cond, F.lit(False))
        counts.append((name, count_if(so_far)))
    one = df.agg(*[c.alias(f"_s{i}") for i, (_, c) in enumerate(counts)])
    rows = [F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("condition"), F.col(f"_s{i}").alias("orders")) for i, (n, _) in enumerate(counts)]
    return one.select(F.inline(F.array(*rows)))


def id_quality(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Valid, malformed and missing identity numbers with the valid share."""
    blank = F.col(col).isNull() | (F.trim(F.col(col).cast("string")) == "")
    state = F.when(blank, "missing").when(id_valid(col), "valid").otherwise("malformed")
    n = lambda s: count_if(F.col("_state") == s).alias(s)
    return (
        df.select(*by, state.alias("_state")).groupBy(*by).agg(F.count("*").alias("orders"), n("valid"), n("missing"), n("malformed"))
        .withColumn("valid_share", ratio(F.col("valid"), F.col("orders")))
    )


def attr_assign(df: DataFrame, attr_map: DataFrame, out: str = "attr", default: str = "unknown") -> DataFrame:
    """Class of the trimmed product name by lookup, default where the map has none."""
    m = attr_map.select(F.col("product").alias("_p"), F.col("attr").alias(out))
    joined = df.join(m, F.trim(F.col("product")) == F.col("_p"), "left").drop("_p")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def price_lookup(df: DataFrame, prices: DataFrame, out: str = "list_price") -> DataFrame:
    """List price by product name; a missing price or a price of 0 is null."""
    p = prices.select(F.col("product").alias("_p"), F.nullif(F.col("price"), F.lit(0)).alias(out))
    return df.join(p, F.col("product") == F.col("_p"), "left").drop("_p")


def dim_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values of a column, sorted."""
    return df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct().orderBy("value")


def date_range(df: DataFrame, col: str, fallback: tuple[str, str]) -> DataFrame:
    """First and last date of a time column, or the fallback on an empty column."""
    lo, hi = (F.lit(x).cast("date") for x in fallback)
    return df.agg(
        F.coalesce(F.to_date(F.min(col)), lo).alias("min_date"), F.coalesce(F.to_date(F.max(col)), hi).alias("max_date")
    )
