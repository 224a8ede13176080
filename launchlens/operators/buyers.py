"""Repeat buyers, buyer history and sales-agent matches.

Everything about a buyer is first reduced to one row per (buyer, ...) by an aggregate
with a map-side combine; a placeholder buyer holding a large part of the orders is then
one row. Where the order of one buyer's payments matters, the work is cut by day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from launchlens.functions.rules import id_valid, product_category
from launchlens.functions.semantics import count_if, interval_days, micros, ratio
from launchlens.operators.periods import period_slice
from launchlens.operators.structure import long_values
from launchlens.plans.skew import previous_value, running_extreme
from launchlens.session import cut_lineage

AGENT_KEYS = ("agent_name", "agent_code", "agent_card")


def buyer_key(mode: str = "id") -> Column:
    """The buyer's identity number, or identity and phone together; null unless all parts are known."""
    if mode == "id":
        return F.col("buyer_id").cast("string")
    if mode == "id_phone":
        return F.concat(F.col("buyer_id").cast("string"), F.lit("_"), F.col("buyer_phone").cast("string"))
    raise ValueError(f"unknown buyer key mode {mode!r}")


def repeat_buyers(df: DataFrame, ref: str | None = None, key: str = "id") -> DataFrame:
    """Buyer keys with more than one order and, given a reference date, an invoice before it."""
    before = F.min("invoice_time") < F.lit(ref).cast("timestamp") if ref else F.lit(True)
    return (
        df.select(buyer_key(key).alias("buyer_key"), "invoice_time")
        .where(F.col("buyer_key").isNotNull())
        .groupBy("buyer_key")
        .agg(F.count("*").alias("orders"), F.coalesce(before, F.lit(False)).alias("_early"))
        .where((F.col("orders") > 1) & F.col("_early"))
        .drop("_early")
    )


def repeat_orders(df: DataFrame) -> DataFrame:
    """All orders of buyers with at least two orders in df."""
    keys = repeat_buyers(df).select(F.col("buyer_key").alias("_k"))
    return df.withColumn("_k", buyer_key()).join(keys, "_k", "left_semi").drop("_k")


def repeat_stats(df: DataFrame, periods: DataFrame) -> DataFrame:
    """Per period: orders, orders of buyers with two or more there, their share, distinct repeat buyers."""
    per_buyer = period_slice(df, periods).groupBy("period", "buyer_id").agg(F.count("*").alias("n"))
    repeat = F.col("buyer_id").isNotNull() & (F.col("n") >= 2)
    agg = per_buyer.groupBy("period").agg(
        F.sum("n").alias("total_orders"),
        F.sum(F.when(repeat, F.col("n")).otherwise(0)).alias("repeat_orders"),
        count_if(repeat).alias("repeat_buyers"),
    )
    return _per_period(periods, agg, ["total_orders", "repeat_orders", "repeat_buyers"]).withColumn(
        "repeat_ratio", ratio(F.col("repeat_orders"), F.col("total_orders"))
    )


def _per_period(periods: DataFrame, agg: DataFrame, counts: Sequence[str]) -> DataFrame:
    named = periods.select(F.col("grp").alias("period"))
    return named.join(agg, "period", "left").select("period", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts])


def ratio_outliers(stats: DataFrame, col: str, limit: float = 0.2) -> DataFrame:
    """Periods with orders whose ratio is more than `limit` (absolute) from the mean over those periods."""
    w = Window.partitionBy(F.lit(0))  # one row per launch
    scored = stats.where(F.col("total_orders") > 0).select("period", col, F.avg(col).over(w).alias("mean_ratio"))
    return scored.withColumn("deviation", F.abs(F.col(col) - F.col("mean_ratio"))).withColumn(
        "outlier", F.col("deviation") > limit
    )


def repeat_profile(df: DataFrame, dims: Sequence[str], k: int = 10, unlimited: Sequence[str] = ()) -> DataFrame:
    """Top-k values per dimension among orders of repeat buyers; dimensions in `unlimited` are listed whole."""
    counts = (
        long_values(repeat_orders(df), dims).where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(F.count("*").alias("orders"))
    )
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.col("orders").desc(), "value"))
    return counts.withColumn("rank", rank).where((F.col("rank") <= k) | F.col("dimension").isin(list(unlimited)))


def repeat_frequency(df: DataFrame) -> DataFrame:
    """Histogram: how many repeat buyers have how many orders."""
    return repeat_buyers(df).groupBy("orders").agg(F.count("*").alias("buyers"))


def repeat_gap_counts(df: DataFrame) -> DataFrame:
    """Whole-day gaps between successive payments of one buyer, as (gap_days, n).

    Equal payment times are counted as gaps of 0; the rest is one row per (buyer, time),
    looked up day by day so that a hot buyer is spread.
    """
    times = (
        df.where(F.col("buyer_id").isNotNull() & F.col("pay_time").isNotNull())
        .groupBy("buyer_id", F.col("pay_time").cast("timestamp").alias("t"))
        .agg(F.count("*").alias("c"))
    )
    linked = previous_value(times, ["buyer_id"], "t", F.to_date("t"), "prev_t")
    gaps = F.array(
        F.struct(F.lit(0).cast("long").alias("gap_days"), (F.col("c") - 1).alias("n")),
        F.struct(interval_days("prev_t", "t").alias("gap_days"), F.when(F.col("prev_t").isNotNull(), F.lit(1)).otherwise(0).cast("long").alias("n")),
    )
    return linked.select(F.inline(gaps)).where(F.col("n") > 0).groupBy("gap_days").agg(F.sum("n").alias("n"))


def repeat_combinations(df: DataFrame) -> DataFrame:
    """Sets of more than one group bought by the same repeat buyer, with the number of buyers."""
    per_group = df.where(F.col("buyer_id").isNotNull()).groupBy("buyer_id", "grp").agg(F.count("*").alias("n"))
    per_buyer = per_group.groupBy("buyer_id").agg(
        F.sum("n").alias("orders"), F.concat_ws("+", F.sort_array(F.collect_set("grp"))).alias("combination"), F.count("grp").alias("groups")
    )
    return (
        per_buyer.where((F.col("orders") >= 2) & (F.col("groups") > 1)).groupBy("combination").agg(F.count("*").alias("buyers"))
    )


def repeat_patterns(df: DataFrame) -> DataFrame:
    """The three pattern tables in one long frame (pattern, key, n)."""
    freq = repeat_frequency(df).select(F.lit("orders_per_buyer").alias("pattern"), F.col("orders").cast("string").alias("key"), F.col("buyers").alias("n"))
    gaps = repeat_gap_counts(df).select(F.lit("gap_days").alias("pattern"), F.col("gap_days").cast("string").alias("key"), "n")
    combos = repeat_combinations(df).select(F.lit("combination").alias("pattern"), F.col("combination").alias("key"), F.col("buyers").alias("n"))
    return freq.unionByName(gaps).unionByName(combos)


def repeat_summary(df: DataFrame, dims: Sequence[str], k: int = 5) -> DataFrame:
    """Long (section, key, value, share): buyers and mean orders, gap statistics, top combinations, top value per dimension."""
    buyers = repeat_buyers(df).agg(F.count("*").alias("b"), F.sum("orders").alias("o"))
    null_s, null_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    head = buyers.select(
        F.inline(
            F.array(
                F.struct(F.lit("buyers").alias("section"), F.lit("repeat_buyers").alias("key"), F.col("b").cast("double").alias("value"), null_d.alias("share")),
                F.struct(F.lit("buyers").alias("section"), F.lit("mean_orders").alias("key"), ratio(F.col("o"), F.col("b")).alias("value"), null_d.alias("share")),
            )
        )
    )
    g = repeat_gap_counts(df).agg(
        ratio(F.sum(F.col("gap_days") * F.col("n")), F.sum("n")).alias("mean"), F.min("gap_days").cast("double").alias("min"), F.max("gap_days").cast("double").alias("max")
    )
    gaps = g.select(
        F.inline(
            F.array(*[F.struct(F.lit("gap_days").alias("section"), F.lit(c).alias("key"), F.col(c).alias("value"), null_d.alias("share")) for c in ("mean", "min", "max")])
        )
    )
    top = repeat_combinations(df).orderBy(F.col("buyers").desc(), "combination").limit(k)
    combos = top.select(F.lit("combination").alias("section"), F.col("combination").alias("key"), F.col("buyers").cast("double").alias("value"), null_d.alias("share"))
    counts = long_values(repeat_orders(df), dims).groupBy("dimension", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("dimension").agg(
        F.sum("n").alias("total"),
        F.min_by(F.struct("value", "n"), F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value")))).alias("b"),
    )
    tops = best.select(
        F.concat(F.lit("top_"), F.col("dimension")).alias("section"), F.coalesce(F.col("b.value"), null_s).alias("key"),
        F.col("b.n").cast("double").alias("value"), ratio(F.col("b.n"), F.col("total")).alias("share"),
    )
    return head.unionByName(gaps).unionByName(combos).unionByName(tops)


def flag_agent_orders(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds is_agent and dealer: agent name, agent id and buyer id all match one registry row.

    The registry has one row per key (scan_registry); Spark broadcasts it when its
    measured size allows it.
    """
    reg = registry.select(
        *[F.col(c).alias(f"_{c}") for c in AGENT_KEYS], F.col("dealer").alias("dealer"), F.lit(True).alias("_hit")
    )
    clean = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    # the registry has no blank key, so rows with one are spread under names that no agent has
    blank = (clean("agent_name") == "") | (clean("agent_id") == "") | (clean("buyer_id") == "")
    varied = [c for c in ("agent_id", "buyer_id", "pay_time") if c in df.columns]
    name = F.when(blank, F.concat(F.lit("\0"), F.xxhash64(*varied).cast("string"))).otherwise(clean("agent_name"))
    cond = (
        (name == F.col("_agent_name"))
        & (clean("agent_id") == F.col("_agent_code"))
        & (clean("buyer_id") == F.col("_agent_card"))
    )
    joined = df.drop("dealer", "is_agent").join(reg, cond, "left")
    return joined.withColumn("is_agent", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit", *[f"_{c}" for c in AGENT_KEYS])


def agent_match(df: DataFrame, periods: DataFrame, registry: DataFrame) -> DataFrame:
    """Per period: orders, agent-matched orders and their share."""
    agg = (
        flag_agent_orders(period_slice(df, periods), registry)
        .groupBy("period")
        .agg(F.count("*").alias("total_orders"), count_if(F.col("is_agent")).alias("agent_orders"))
    )
    return _per_period(periods, agg, ["total_orders", "agent_orders"]).withColumn(
        "agent_ratio", ratio(F.col("agent_orders"), F.col("total_orders"))
    )


def agent_detail(df: DataFrame, registry: DataFrame, date: str, region: str) -> DataFrame:
    """Orders paid on one date in one region by agent triple, with the dealer; unmatched triples included."""
    day = df.where((F.to_date("pay_time") == F.lit(date).cast("date")) & (F.col("region") == region))
    return (
        flag_agent_orders(day, registry)
        .groupBy("is_agent", "dealer", "agent_name", "agent_id", "buyer_id")
        .agg(F.count("*").alias("orders"))
    )


def agent_dealers(detail: DataFrame) -> DataFrame:
    """Matched orders per dealer."""
    return detail.where("is_agent").groupBy("dealer").agg(F.sum("orders").alias("orders"))


def agent_quality(detail: DataFrame) -> DataFrame:
    """Unmatched share with a level, and the shape of the matched agents."""
    matched = F.col("is_agent")
    multi = matched & (F.col("orders") > 1)
    top = F.min_by("agent_name", F.when(matched, F.struct(-F.col("orders"), F.col("agent_name"), F.col("agent_id"), F.col("buyer_id"))))
    agg = detail.agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders"),
        F.coalesce(F.sum(F.when(matched, F.col("orders"))), F.lit(0)).alias("matched_orders"),
        count_if(matched).alias("agents"),
        top.alias("top_agent"),
        F.max(F.when(matched, F.col("orders"))).alias("top_agent_orders"),
        count_if(multi).alias("multi_order_agents"),
        F.avg(F.when(multi, F.col("orders"))).alias("mean_orders_of_multi"),
    )
    unmatched = ratio(F.col("total_orders") - F.col("matched_orders"), F.col("total_orders"), None)
    return agg.withColumn("unmatched_ratio", unmatched).withColumn(
        "level", F.when(unmatched > 0.5, "low").when(unmatched > 0.2, "medium").when(unmatched.isNotNull(), "high")
    )


def repeat_agent(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Share of repeat buyers' orders that match the registry."""
    return flag_agent_orders(repeat_orders(df), registry).agg(
        F.count("*").alias("repeat_orders"), count_if(F.col("is_agent")).alias("matched_orders")
    ).withColumn("match_ratio", ratio(F.col("matched_orders"), F.col("repeat_orders")))


def repeat_order_list(df: DataFrame, ref: str, lo: str, hi: str, group: str, valid_ids_only: bool = True) -> DataFrame:
    """All orders of repeat buyers (an invoice before ref) who locked in [lo, hi] for the group, tagged."""
    base = df.where(F.trim(F.coalesce(buyer_key(), F.lit(""))) != "")
    if valid_ids_only:
        base = base.where(id_valid("buyer_id"))
    qualifies = (
        (F.col("lock_time") >= F.lit(lo).cast("timestamp")) & (F.col("lock_time") <= F.lit(hi).cast("timestamp")) & (F.col("grp") == group)
    )
    keys = (
        base.groupBy(buyer_key().alias("_k"))
        .agg(F.count("*").alias("n"), F.min("invoice_time").alias("first_invoice"), count_if(qualifies).alias("q"))
        .where((F.col("n") > 1) & (F.col("first_invoice") < F.lit(ref).cast("timestamp")) & (F.col("q") > 0))
    )
    tag = F.when(F.coalesce(qualifies, F.lit(False)), "qualifying").otherwise("earlier")
    return base.withColumn("_k", buyer_key()).join(keys, "_k", "left_semi").select(
        "buyer_id", "order_id", "lock_time", "grp", "product", product_category("product").alias("category"), "invoice_time", tag.alias("tag")
    )


def locked_order_list(df: DataFrame, lo: str, hi: str, group: str) -> DataFrame:
    """Orders of a group locked in [lo, hi] with their product category."""
    t = F.col("lock_time")
    kept = df.where((t >= F.lit(lo).cast("timestamp")) & (t <= F.lit(hi).cast("timestamp")) & (F.col("grp") == group))
    return kept.select("order_id", "lock_time", "buyer_id", "grp", "invoice_time", "product", product_category("product").alias("category"))


def locks_per_day(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.to_date("lock_time").alias("date")).agg(F.count("*").alias("orders"))


def buyer_history(df: DataFrame, key: str = "id", null_keys: str = "strict") -> DataFrame:
    """Per order: is_repeat, orders_of_buyer, last_invoice_gap_days, from the buyer's earlier payments.

    A prior payment or invoice counts when it lies strictly before the payment. Orders
    without a buyer key have no history; null_keys='shared' gives them one common key.
    """
    k = buyer_key(key)
    if null_keys == "shared":
        k = F.coalesce(k, F.lit("nan"))
    invoice = F.col("invoice_time") if "invoice_time" in df.columns else F.lit(None)
    # the one read of the orders; a row without a buyer gets a key of its own, so they meet nowhere
    own = F.concat(F.lit("\0"), F.col("order_id").cast("string"))
    keyed = cut_lineage(df.withColumns({"_k": F.coalesce(k, own, F.lit("\0")), "_known": k.isNotNull()}))
    pay = F.col("pay_time").cast("timestamp")
    linked = running_extreme(
        keyed,
        ["_k"],
        micros("pay_time"),
        F.to_date(pay),
        {"_prev_pay": ("max", pay), "_prev_invoice": ("max", invoice.cast("timestamp"))},
        ties=[F.col("order_id")],
        count_as="orders_of_buyer",
    )
    known = lambda c: F.when(F.col("_known"), F.col(c))
    rows = linked.withColumns({"_prev_pay": known("_prev_pay"), "_prev_invoice": known("_prev_invoice"), "orders_of_buyer": F.coalesce(known("orders_of_buyer"), F.lit(1))})
    valid_invoice = F.when(F.col("_prev_invoice") < pay, F.col("_prev_invoice"))
    repeat = F.coalesce(F.col("_prev_pay") < pay, F.lit(False)) | valid_invoice.isNotNull()
    return rows.select(
        *df.columns,
        repeat.cast("int").alias("is_repeat"),
        "orders_of_buyer",
        interval_days(valid_invoice, pay, whole=False).alias("last_invoice_gap_days"),
    )
