"""Distribution shifts: launch against history, A/B samples, day-over-day refunds.

All checks return typed long rows; each reads its orders once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from launchlens.functions.semantics import count_if, ratio, rel_change
from launchlens.operators.cohorts import interval_stats_by
from launchlens.session import cut_lineage

ANOMALY_COLUMNS = (
    "check", "baseline", "dimension", "value", "target_n", "target_share", "base_n", "base_share", "change", "direction",
)


def long_values(df: DataFrame, dims: Sequence[str], keep: Sequence[str | Column] = ()) -> DataFrame:
    """One row per (row, dimension) with the value as string; a projection, not a join."""
    structs = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]
    return df.select(*keep, F.inline(F.array(*structs)))


def value_share(df: DataFrame, dims: Sequence[str], by: Sequence[str] = (), count_nulls: bool = False) -> DataFrame:
    """Count and share of each value per dimension; nulls leave numerator and denominator unless counted."""
    rows = long_values(df, dims, list(by))
    if not count_nulls:
        rows = rows.where(F.col("value").isNotNull())
    counts = rows.groupBy(*by, "dimension", "value").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by, "dimension"))
    return counts.withColumn("share", ratio(F.col("n"), total))


def _shift_rows(
    compared: DataFrame, check: str, baseline: str, threshold: float, floor: float | None, new_values: bool
) -> DataFrame:
    """Flags rows of (dimension, value, target_n, target_share, base_n, base_share)."""
    change = rel_change(F.col("target_share"), F.col("base_share"))
    seen = F.col("target_share") > floor if floor is not None else F.lit(True)
    moved = (F.col("base_share") > 0) & seen & (F.abs(change) > threshold)
    fresh = (F.col("base_share") == 0) & seen if new_values else F.lit(False)
    direction = F.when(fresh, "new").when(change > 0, "up").otherwise("down")
    return compared.where(moved | fresh).select(
        F.lit(check).alias("check"),
        F.lit(baseline).alias("baseline"),
        "dimension",
        "value",
        F.col("target_n").cast("long").alias("target_n"),
        "target_share",
        F.col("base_n").cast("long").alias("base_n"),
        "base_share",
        change.alias("change"),
        direction.alias("direction"),
    )


def share_shift(
    sliced: DataFrame,
    target: str,
    history: Sequence[str],
    dims: Sequence[str],
    threshold: float,
    floor: float | None = 0.01,
    new_values: bool = True,
    check: str = "structure",
    baseline: str = "history",
) -> DataFrame:
    """Target launch's shares against the mean share over history launches (missing counts as 0).

    `sliced` has one row per order and period. A history of one launch is the direct comparison.
    """
    wanted = sliced.where(F.col("period").isin([target, *history]))
    counts = long_values(wanted, dims, ["period"]).groupBy("period", "dimension", "value").agg(F.count("*").alias("n"))
    # launches with orders count in the mean even where the dimension is null throughout
    launches = counts.where(F.col("period") != target).groupBy("dimension").agg(F.count_distinct("period").alias("_launches"))
    total = F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).over(Window.partitionBy("period", "dimension"))
    shares = counts.withColumn("_share", ratio(F.col("n"), total)).where(F.col("value").isNotNull()).join(launches, "dimension")
    is_t = F.col("period") == target
    zero = lambda c: F.coalesce(c, F.lit(0))
    compared = shares.groupBy("dimension", "value").agg(
        zero(F.sum(F.when(is_t, F.col("n")))).alias("target_n"),
        F.coalesce(F.sum(F.when(is_t, F.col("_share"))), F.lit(0.0)).alias("target_share"),
        zero(F.sum(F.when(~is_t, F.col("n")))).alias("base_n"),
        F.coalesce(F.sum(F.when(~is_t, F.col("_share"))) / F.max("_launches"), F.lit(0.0)).alias("base_share"),
    )
    return _shift_rows(compared, check, baseline, threshold, floor, new_values)


def share_shift_refund(
    orders: DataFrame, dims: Sequence[str], threshold: float, floor: float | None = 0.01, new_values: bool = True,
    check: str = "refund_structure",
) -> DataFrame:
    """Shares among the refunded orders of a launch against its overall shares."""
    rows = long_values(orders, dims, [F.col("refund_time").isNotNull().alias("_r")]).where(F.col("value").isNotNull())
    counts = rows.groupBy("dimension", "value").agg(F.count("*").alias("base_n"), count_if(F.col("_r")).alias("target_n"))
    w = Window.partitionBy("dimension")
    compared = counts.select(
        "dimension", "value", "target_n", "base_n",
        ratio(F.col("target_n"), F.sum("target_n").over(w)).alias("target_share"),
        ratio(F.col("base_n"), F.sum("base_n").over(w)).alias("base_share"),
        F.sum("target_n").over(w).alias("_refunded"),
    ).where(F.col("_refunded") > 0)
    return _shift_rows(compared, check, "overall", threshold, floor, new_values)


def refund_dod(
    orders: DataFrame, dims: Sequence[str], as_of: str | None = None, threshold: float = 0.10, new_min: int = 2,
    check: str = "refund_day_over_day",
) -> DataFrame:
    """Refunds per value on the latest pay date against the day before, for every dimension; the orders are read once.

    With `as_of` only the refunds of that day and the day before are counted. Without, the latest pay date comes
    from the same counts per value and refund day.
    """
    day = F.to_date("refund_time")
    if as_of is not None:
        latest = F.lit(as_of).cast("date")
        orders = orders.where(day.between(F.date_sub(latest, 1), latest))
    rows = long_values(orders, dims, [day.alias("_day"), F.to_date("pay_time").alias("_pay")])
    counts = rows.groupBy("dimension", "value", "_day").agg(F.count("*").alias("n"), F.max("_pay").alias("_pay"))
    if as_of is None:
        counts = cut_lineage(counts)
        latest = counts.agg(F.max("_pay")).scalar()
    joined = counts.where("value is not null and _day is not null").withColumn("_latest", latest)
    compared = joined.groupBy("dimension", "value").agg(
        F.coalesce(F.sum(F.when(F.col("_day") == F.col("_latest"), F.col("n"))), F.lit(0)).alias("target_n"),
        F.coalesce(F.sum(F.when(F.col("_day") == F.date_sub("_latest", 1), F.col("n"))), F.lit(0)).alias("base_n"),
    )
    change = rel_change(F.col("target_n"), F.col("base_n"))
    moved = (F.col("base_n") > 0) & (F.col("target_n") >= 1) & (F.abs(change) > threshold)
    fresh = (F.col("base_n") == 0) & (F.col("target_n") >= new_min)
    null = F.lit(None).cast("double")
    return compared.where(moved | fresh).select(
        F.lit(check).alias("check"), F.lit("previous_day").alias("baseline"), "dimension", "value",
        "target_n", null.alias("target_share"), "base_n", null.alias("base_share"), change.alias("change"),
        F.when(fresh, "new").when(change > 0, "up").otherwise("down").alias("direction"),
    )


def ab_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("sample", F.lit("A")).unionByName(b.withColumn("sample", F.lit("B")))


def ab_shift(
    a: DataFrame,
    b: DataFrame,
    dims: Sequence[str],
    threshold: float,
    floor: float | None = 0.01,
    count_threshold: float = 0.5,
    check: str = "region",
    regions: Sequence[str] | None = None,
    region_col: str = "region",
) -> DataFrame:
    """Sample A against B per value: share moved, count moved, or new.

    `regions` restricts both samples to parent regions and leaves the parent dimension out.
    """
    if regions:
        inside = F.col(region_col).isin(list(regions))
        a, b, dims = a.where(inside), b.where(inside), [d for d in dims if d != region_col]
    return _ab_checks(a, b, {check: (dims, threshold, floor)}, count_threshold)


def _ab_checks(
    a: DataFrame, b: DataFrame, checks: dict[str, tuple[Sequence[str], float, float | None]], count_threshold: float
) -> DataFrame:
    """All checks over one counting of both samples; `checks` maps name to (dims, threshold, floor)."""
    dims = {name: list(c[0]) for name, c in checks.items()}
    rows = long_values(ab_union(a, b), [x for d in dims.values() for x in d], ["sample"]).where(F.col("value").isNotNull())
    is_a = F.col("sample") == "A"
    counts = rows.groupBy("dimension", "value").agg(count_if(is_a).alias("a_n"), count_if(~is_a).alias("b_n"))
    w = Window.partitionBy("dimension")
    shared = counts.select(
        "*",
        ratio(F.col("a_n"), F.sum("a_n").over(w)).alias("a_share"),
        ratio(F.col("b_n"), F.sum("b_n").over(w)).alias("b_share"),
    )
    floors = _by_dimension(dims, {name: -1.0 if c[2] is None else c[2] for name, c in checks.items()})
    threshold = _by_dimension(dims, {name: c[1] for name, c in checks.items()})
    change = rel_change(F.col("a_share"), F.col("b_share"))
    moved = (F.col("b_share") > 0) & (F.col("a_share") > floors) & (F.abs(change) > threshold)
    count_change = rel_change(F.col("a_n"), F.col("b_n"))
    counted = F.when(F.col("b_n") > 0, F.abs(count_change) > count_threshold).otherwise(F.col("a_n") > 0)
    flagged = shared.withColumn("structure_flag", F.coalesce(moved, F.lit(False))).withColumn("count_flag", counted)
    kind = (
        F.when(F.col("b_share") == 0, "new")
        .when(F.col("structure_flag") & F.col("count_flag"), "structure/count")
        .when(F.col("structure_flag"), "structure")
        .otherwise("count")
    )
    return flagged.where(F.col("structure_flag") | F.col("count_flag")).select(
        _by_dimension(dims, {name: name for name in dims}).alias("check"), "dimension", "value", kind.alias("kind"),
        "a_n", "b_n", "a_share", "b_share", (F.col("a_share") - F.col("b_share")).alias("change"), count_change.alias("relative_change"),
    )


# The three interval metrics of an A/B comparison.
AB_INTERVALS = {
    "pay_to_refund": ("pay_time", "refund_time"),
    "pay_to_assign": ("pay_time", "assign_time"),
    "pay_to_lock": ("pay_time", "lock_time"),
}


def ab_interval(a: DataFrame, b: DataFrame, pairs: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Count, mean, median and sample std of whole-day intervals per sample, and A minus B."""
    stats = interval_stats_by(ab_union(a, b), ["sample"], pairs or AB_INTERVALS)
    side = lambda s, c: F.max(F.when(F.col("sample") == s, F.col(c)))
    cols = {"count": "count", "mean": "mean", "median": "median", "std": "std_samp"}
    out = stats.groupBy("metric").agg(*[side(s, c).cast("double").alias(f"{s.lower()}_{k}") for k, c in cols.items() for s in "AB"])
    return out.select("*", *[(F.col(f"a_{k}") - F.col(f"b_{k}")).alias(f"diff_{k}") for k in ("mean", "median")])


def ab_agent(a: DataFrame, b: DataFrame, registry: DataFrame) -> DataFrame:
    """Orders, buyers, agent-matched orders, repeat orders and buyers by id and by id+phone, per sample.

    Repeat counts come from one row per (sample, buyer, phone), so a hot buyer is one row.
    """
    from launchlens.operators.buyers import flag_agent_orders

    both = flag_agent_orders(ab_union(a, b), registry)
    per_phone = both.groupBy("sample", "buyer_id", "buyer_phone").agg(
        F.count("*").alias("n"), count_if(F.col("is_agent")).alias("agent")
    )
    combo = F.col("buyer_id").isNotNull() & F.col("buyer_phone").isNotNull() & (F.col("n") >= 2)
    per_buyer = per_phone.groupBy("sample", "buyer_id").agg(
        F.sum("n").alias("n"),
        F.sum("agent").alias("agent"),
        F.sum(F.when(combo, F.col("n")).otherwise(0)).alias("combo_orders"),
        count_if(combo).alias("combo_buyers"),
    )
    known = F.col("buyer_id").isNotNull()
    repeat = known & (F.col("n") >= 2)
    per_sample = per_buyer.groupBy("sample").agg(
        F.sum("n").alias("total_orders"),
        count_if(known).alias("unique_buyers"),
        F.sum("agent").alias("agent_orders"),
        F.sum(F.when(repeat, F.col("n")).otherwise(0)).alias("repeat_orders"),
        count_if(repeat).alias("repeat_buyers"),
        F.sum("combo_orders").alias("repeat_orders_combo"),
        F.sum("combo_buyers").alias("repeat_buyers_combo"),
    )
    share = lambda c: ratio(F.col(c), F.col("total_orders"))
    values = {
        "total_orders": F.col("total_orders"), "unique_buyers": F.col("unique_buyers"),
        "agent_orders": F.col("agent_orders"), "agent_ratio": share("agent_orders"),
        "repeat_orders": F.col("repeat_orders"), "repeat_ratio": share("repeat_orders"), "repeat_buyers": F.col("repeat_buyers"),
        "repeat_orders_combo": F.col("repeat_orders_combo"), "repeat_ratio_combo": share("repeat_orders_combo"),
        "repeat_buyers_combo": F.col("repeat_buyers_combo"),
    }
    metrics = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("v")) for k, v in values.items()])
    rows = per_sample.select("sample", F.inline(metrics))
    side = lambda s: F.coalesce(F.max(F.when(F.col("sample") == s, F.col("v"))), F.lit(0.0))
    return rows.groupBy("metric").agg(side("A").alias("a"), side("B").alias("b")).withColumn("diff", F.col("a") - F.col("b"))


# Share thresholds of the A/B checks.
AB_THRESHOLDS = {"region": 0.10, "channel": 0.15, "gender": 0.10, "age": 0.15}


def ab_report(a: DataFrame, b: DataFrame, dims: dict[str, Sequence[str]]) -> DataFrame:
    """All A/B shift checks in one table; `dims` maps region / channel / gender / age to columns."""
    return _ab_checks(a, b, {n: (cols, AB_THRESHOLDS[n], None if n == "gender" else 0.01) for n, cols in dims.items()}, 0.5)


def counts_by_kind(report: DataFrame, keys: Sequence[str] = ("check", "kind")) -> DataFrame:
    return report.groupBy(*keys).agg(F.count("*").alias("n"))


# Thresholds of the launch checks.
SHIFT_THRESHOLDS = {"region": 0.20, "channel": 0.15, "gender": 0.10, "age": 0.10}
REFUND_THRESHOLDS = {"region": 0.20, "channel": 0.20, "gender": 0.15, "age": 0.15}
DEMOGRAPHIC = ("gender", "age")


def _by_dimension(dims: dict[str, Sequence[str]], values: dict[str, object]) -> Column:
    """The value configured for the row's dimension."""
    out = None
    for name, cols in dims.items():
        hit = F.col("dimension").isin(list(cols))
        out = F.when(hit, F.lit(values[name])) if out is None else out.when(hit, F.lit(values[name]))
    return out


def launch_checks(
    sliced: DataFrame, target: str, history: Sequence[str], reference: str, dims: dict[str, Sequence[str]]
) -> DataFrame:
    """Every structure check of a launch in one long table: history, reference launch, refunds, day over day.

    The orders are counted once per (period, dimension, value); all checks are columns of
    that small table and leave it as rows.
    """
    all_dims = [c for cols in dims.values() for c in cols]
    wanted = sliced.where(F.col("period").isin([target, *history]))
    # refund days of the target, since its latest pay date is known from the counts only
    refunded = F.col("refund_time").isNotNull()
    day = F.when(F.col("period") == target, F.to_date("refund_time"))
    rows = long_values(wanted, all_dims, ["period", day.alias("_day"), refunded.alias("_refunded"), F.to_date("pay_time").alias("_pay")])
    daily = cut_lineage(rows.groupBy("period", "dimension", "value", "_day", "_refunded").agg(F.count("*").alias("n"), F.max("_pay").alias("_pay")))
    latest = daily.where(F.col("period") == target).agg(F.max("_pay")).scalar()
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    counts = daily.withColumn("_latest", latest).groupBy("period", "dimension", "value").agg(
        F.sum("n").alias("n"),
        some(F.col("_refunded")).alias("refunded"),
        some(F.col("_day") == F.col("_latest")).alias("on_day"),
        some(F.col("_day") == F.date_sub("_latest", 1)).alias("day_before"),
    )
    launches = counts.where(F.col("period") != target).groupBy("dimension").agg(F.count_distinct("period").alias("_launches"))
    known = counts.where(F.col("value").isNotNull())
    w = Window.partitionBy("period", "dimension")
    shares = known.withColumn("share", ratio(F.col("n"), F.sum("n").over(w))).withColumn(
        "refunded_share", F.try_divide(F.col("refunded").cast("double"), F.sum("refunded").over(w).cast("double"))
    )
    is_t, is_r = F.col("period") == target, F.col("period") == reference
    count = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    share = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0.0))
    wide = shares.join(launches, "dimension", "left").groupBy("dimension", "value").agg(
        count("n", is_t).alias("t_n"), share("share", is_t).alias("t_s"),
        count("n", ~is_t).alias("h_n"), F.try_divide(share("share", ~is_t), F.max("_launches")).alias("h_s"),
        count("n", is_r).alias("r_n"), share("share", is_r).alias("r_s"),
        count("refunded", is_t).alias("f_n"), F.max(F.when(is_t, F.col("refunded_share"))).alias("f_s"),
        count("on_day", is_t).alias("d_n"), count("day_before", is_t).alias("p_n"),
    )
    demographic = {k: k in DEMOGRAPHIC for k in dims}
    free = _by_dimension(dims, demographic)
    checks = []
    for baseline, (tn, tsh, bn, bsh), limits in (
        ("history", ("t_n", "t_s", "h_n", "h_s"), SHIFT_THRESHOLDS),
        ("reference", ("t_n", "t_s", "r_n", "r_s"), SHIFT_THRESHOLDS),
        ("overall", ("f_n", "f_s", "t_n", "t_s"), REFUND_THRESHOLDS),
    ):
        change = rel_change(F.col(tsh), F.col(bsh))
        seen = free | (F.col(tsh) > 0.01)
        moved = (F.col(bsh) > 0) & seen & (F.abs(change) > _by_dimension(dims, limits))
        fresh = (F.col(bsh) == 0) & ~free & seen
        checks.append((baseline, tn, F.col(tsh), bn, F.col(bsh), change, moved, fresh))
    change = rel_change(F.col("d_n"), F.col("p_n"))
    moved = (F.col("p_n") > 0) & (F.col("d_n") >= 1) & (F.abs(change) > 0.10)
    null = F.lit(None).cast("double")
    checks.append(("previous_day", "d_n", null, "p_n", null, change, moved, (F.col("p_n") == 0) & (F.col("d_n") >= 2)))
    structs = [
        F.struct(
            F.lit(baseline).alias("baseline"), F.col(tn).alias("target_n"), tsh.alias("target_share"), F.col(bn).alias("base_n"),
            bsh.alias("base_share"), change.alias("change"),
            F.when(fresh, "new").when(change > 0, "up").otherwise("down").alias("direction"),
            F.coalesce(moved | fresh, F.lit(False)).alias("_hit"),
        )
        for baseline, tn, tsh, bn, bsh, change, moved, fresh in checks
    ]
    name = _by_dimension(dims, {k: k for k in dims}).alias("check")
    return wide.select(name, "dimension", "value", F.inline(F.array(*structs))).where("_hit").select(*ANOMALY_COLUMNS)


def anomaly_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("check", "baseline", "direction").agg(F.count("*").alias("n"))
