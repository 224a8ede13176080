"""Daily curves and their comparisons.

Orders are first counted per (group, day) with a map-side combine; windows only
ever see these daily rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from launchlens.functions.semantics import (
    micros,
    count_if,
    day_index,
    days_from_end,
    in_period,
    midnight,
    plus_days,
    ratio,
    rel_change,
)
from launchlens.operators.periods import group_period, period_slice
from launchlens.plans.skew import with_row
from launchlens.session import cut_lineage

UP = Window.unboundedPreceding


def _by(*keys: str):
    return Window.partitionBy(*keys)


def _daily(df: DataFrame, ts: str, periods: DataFrame, **aggs: Column) -> DataFrame:
    """Orders per (grp, date of ts) joined to the group's period after counting."""
    counted = (
        df.where(F.col(ts).isNotNull())
        .groupBy("grp", F.to_date(ts).alias("date"))
        .agg(*[a.alias(k) for k, a in aggs.items()])
    )
    return group_period(counted, periods)


def wide(df: DataFrame, key: str, groups: Sequence[str], values: Sequence[str], by: str = "grp") -> DataFrame:
    """One row per key with <group>_<value> columns; the group list is given, so no extra job finds it."""
    cols = [
        F.max(F.when(F.col(by) == g, F.col(v))).alias(f"{g}_{v}") for v in values for g in groups
    ]
    return df.groupBy(key).agg(*cols)


def daily_curve(df: DataFrame, periods: DataFrame) -> DataFrame:
    """Orders per presale day (whole end day kept), cumulative, % change to the previous observed day."""
    days = _daily(df, "pay_time", periods, daily_orders=F.count("*")).where(
        F.col("date").between(F.col("start_date"), F.col("end_date"))
    )
    w = _by("grp").orderBy("date")
    prev = F.lag("daily_orders").over(w)
    return days.select(
        "grp",
        "date",
        day_index("date", "start_date").alias("day"),
        "daily_orders",
        F.sum("daily_orders").over(w.rowsBetween(UP, 0)).alias("cumulative_orders"),
        (rel_change(F.col("daily_orders"), prev) * 100).alias("change_pct"),
    )


def period_daily(df: DataFrame, periods: DataFrame) -> DataFrame:
    """Per period (by pay time): every day with an order or a refund, counts and running totals.

    The one small table behind all comparisons of launches by relative day.
    """
    events = F.array(
        F.struct(F.to_date("pay_time").alias("date"), F.lit(1).alias("o"), F.lit(0).alias("r")),
        F.struct(F.to_date("refund_time").alias("date"), F.lit(0).alias("o"), F.lit(1).alias("r")),
    )
    days = (
        period_slice(df, periods)
        .select("period", "start_date", "end_date", F.inline(events))
        .where(F.col("date").isNotNull())
        .groupBy("period", "start_date", "end_date", "date")
        .agg(F.sum("o").alias("orders"), F.sum("r").alias("refunds"))
    )
    # launches x days rows, read by several comparisons: materialised once
    days = cut_lineage(days)
    upto = _by("period").orderBy("date").rowsBetween(UP, 0)
    return days.select(
        "period",
        "start_date",
        "end_date",
        "date",
        day_index("date", "start_date").alias("day"),
        "orders",
        "refunds",
        F.sum("orders").over(upto).alias("cum_orders"),
        F.sum("refunds").over(upto).alias("cum_refunds"),
    )


def order_days(days: DataFrame) -> DataFrame:
    return days.where(F.col("orders") > 0)


def dod_anomaly(days: DataFrame, target: str, threshold: float = 0.5) -> DataFrame:
    """Days whose orders changed by more than the threshold against the previous observed day."""
    prev = F.lag("orders").over(_by("period").orderBy("date"))
    flagged = order_days(days).where(F.col("period") == target).withColumn("prev_orders", prev)
    return (
        flagged.withColumn("change", rel_change(F.col("orders"), F.col("prev_orders")))
        .where(F.abs("change") > threshold)
        .select("period", "date", "orders", "prev_orders", "change")
    )


def aligned_anomaly(days: DataFrame, target: str, threshold: float = 1.0) -> DataFrame:
    """Target days against the same day-from-start of every other launch."""
    own = order_days(days)
    t = own.where(F.col("period") == target).select("day", F.col("date"), F.col("orders").alias("target_orders"))
    o = own.where(F.col("period") != target).select("day", F.col("period").alias("base"), F.col("orders").alias("base_orders"))
    return (
        t.join(o, "day")
        .withColumn("change", rel_change(F.col("target_orders"), F.col("base_orders")))
        .where(F.abs("change") > threshold)
        .select("base", "date", "day", "target_orders", "base_orders", "change")
    )


def _cum_as_of(days: DataFrame, wanted: DataFrame) -> DataFrame:
    """Running totals of each period as of every wanted (period, day): its last day not after it.

    Both sides are daily rows, merged in one window instead of a range join.
    """
    facts = days.select("period", "day", F.lit(0).alias("_q"), "cum_orders", "cum_refunds")
    asks = wanted.select("period", "day").distinct().select(
        "period", "day", F.lit(1).alias("_q"),
        F.lit(None).cast("long").alias("cum_orders"), F.lit(None).cast("long").alias("cum_refunds"),
    )
    w = _by("period").orderBy("day", "_q").rowsBetween(UP, 0)
    merged = facts.unionByName(asks).select(
        "period", "day", "_q",
        F.last("cum_orders", ignorenulls=True).over(w).alias("cum_orders"),
        F.last("cum_refunds", ignorenulls=True).over(w).alias("cum_refunds"),
    )
    return merged.where(F.col("_q") == 1).drop("_q")


def aligned_cum_anomaly(days: DataFrame, target: str, threshold: float = 1.0) -> DataFrame:
    """The same on running totals; a launch without an order on the day counts up to its last one before."""
    t = order_days(days).where(F.col("period") == target).select(
        "day", "date", F.col("cum_orders").alias("target_cum")
    )
    others = days.where(F.col("period") != target)
    names = others.agg(F.collect_set("period")).scalar()  # one entry per launch
    wanted = t.select("day", F.explode(names).alias("period"))
    asked = _cum_as_of(others, wanted)
    base = asked.where(F.col("cum_orders") > 0).select("day", F.col("period").alias("base"), F.col("cum_orders").alias("base_cum"))
    return (
        t.join(base, "day")
        .withColumn("change", rel_change(F.col("target_cum"), F.col("base_cum")))
        .where(F.abs("change") > threshold)
        .select("base", "date", "day", "target_cum", "base_cum", "change")
    )


def nth_last_day(days: DataFrame, target: str, n: int, count: str) -> DataFrame:
    """The target's n-th last day having a positive count."""
    rn = F.row_number().over(_by("period").orderBy(F.col("date").desc()))
    own = days.where((F.col("period") == target) & (F.col(count) > 0))
    return own.withColumn("_rn", rn).where(F.col("_rn") == n).select("day")


def _compare_on(days: DataFrame, target: str, n: int, count: str, cum: str) -> DataFrame:
    at = nth_last_day(days, target, n, count)
    return (
        days.where(F.col(count) > 0)
        .join(at, "day", "left_semi")
        .select((F.col("period") == target).alias("is_target"), "period", "date", "day", count, cum)
    )


def latest_day_compare(days: DataFrame, target: str) -> DataFrame:
    """The target's last order day; other launches at the same relative day."""
    return _compare_on(days, target, 1, "orders", "cum_orders")


def latest_refund_compare(days: DataFrame, target: str) -> DataFrame:
    """The target's last refund day; other launches at the same relative day."""
    return _compare_on(days, target, 1, "refunds", "cum_refunds")


def nth_last_compare(days: DataFrame, target: str, n: int = 2) -> DataFrame:
    """Orders, refunds and both running totals on the target's n-th last order day, all launches aligned."""
    at = nth_last_day(days, target, n, "orders")
    return (
        order_days(days)
        .join(at, "day", "left_semi")
        .select((F.col("period") == target).alias("is_target"), "period", "date", "day", "orders", "refunds", "cum_orders", "cum_refunds")
    )


def cum_refund_rate(days: DataFrame, dense_days: bool = False) -> DataFrame:
    """Cumulative refunds over cumulative orders by day.

    By default refunds are joined to order days only and carried forward, so refunds on
    a day without orders show from the next order day with refunds on. dense_days
    keeps every day that has either.
    """
    if dense_days:
        rows = days.withColumn("refunds_shown", F.col("cum_refunds"))
    else:
        seen = F.when(F.col("refunds") > 0, F.col("cum_refunds"))
        carried = F.last(seen, ignorenulls=True).over(_by("period").orderBy("date").rowsBetween(UP, 0))
        rows = order_days(days).withColumn("refunds_shown", F.coalesce(carried, F.lit(0)))
    return rows.where(F.col("day") >= 1).select(
        "period",
        "date",
        "day",
        "cum_orders",
        F.col("refunds_shown").alias("cum_refunds"),
        (ratio(F.col("refunds_shown"), F.col("cum_orders")) * 100).alias("refund_rate_pct"),
    )


def refund_progress(rates: DataFrame, periods: DataFrame, target: str, step: int = 10) -> DataFrame:
    """Refund rate at 0..100 % of the presale: the last day not after the mark, else the earliest day.

    The target is shown only up to the progress it has reached.
    """
    total = F.datediff("end_date", "start_date")
    offset = F.col("day") - 1
    marks = periods.select(
        F.col("grp").alias("period"), total.alias("_total"), F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(step))).alias("pct")
    )
    joined = marks.join(rates, "period")
    mark_day = F.floor(F.col("_total") * F.col("pct") / 100)
    before = F.when(offset <= mark_day, F.col("day"))
    picked = joined.groupBy("period", "pct", "_total").agg(
        F.max_by("refund_rate_pct", before).alias("_at"),
        F.min_by("refund_rate_pct", F.col("day")).alias("_first"),
        F.max(before).alias("_has"),
        F.max(offset).alias("_reached"),
    )
    reached_pct = F.floor(ratio(F.col("_reached"), F.col("_total")) * 100)
    return picked.where((F.col("period") != target) | (F.col("pct") <= reached_pct)).select(
        "period", "pct", F.when(F.col("_has").isNotNull(), F.col("_at")).otherwise(F.col("_first")).alias("refund_rate_pct")
    )


def refund_rate_jump(days: DataFrame, target: str, floor_pct: float = 20.0, factor: float = 1.5) -> DataFrame:
    """Change of the target's cumulative refund rate on its last order day.

    The threshold is the larger of floor_pct and factor times the mean absolute change
    other launches showed on the previous day's aligned position.
    """
    pct = lambda r, o: ratio(r, o) * 100
    latest = cum_refund_rate(days).where(F.col("period") == target)
    current = latest.agg(F.max_by("refund_rate_pct", "day").alias("current_rate_pct"))
    at = nth_last_day(days, target, 2, "orders")
    previous = order_days(days).where(F.col("period") == target).join(at, "day").agg(
        F.coalesce(F.max(pct(F.col("cum_refunds"), F.col("cum_orders"))), F.lit(0.0)).alias("previous_rate_pct")
    )
    others = days.where(F.col("period") != target)
    on_day = order_days(others).join(at, "day").select("period", "day")
    now = _cum_as_of(others, on_day).select("period", pct(F.col("cum_refunds"), F.col("cum_orders")).alias("_now"))
    before = _cum_as_of(others, on_day.select("period", (F.col("day") - 1).alias("day"))).select(
        "period", pct(F.coalesce("cum_refunds", F.lit(0)), F.coalesce("cum_orders", F.lit(0))).alias("_before")
    )
    history = now.join(before, "period").where(F.col("_before") > 0).agg(
        F.count("*").alias("launches"),
        F.avg(F.abs(rel_change(F.col("_now"), F.col("_before")) * 100)).alias("mean_history_change_pct"),
    )
    row = with_row(with_row(current, previous), history)
    change = ratio(F.col("current_rate_pct") - F.col("previous_rate_pct"), F.col("previous_rate_pct")) * 100
    threshold = F.greatest(F.lit(floor_pct), F.coalesce(F.col("mean_history_change_pct") * factor, F.lit(floor_pct)))
    return row.select(
        "current_rate_pct", "previous_rate_pct", change.alias("change_pct"), "launches", "mean_history_change_pct",
        threshold.alias("threshold_pct"), (F.abs(change) > threshold).alias("is_anomaly"),
    )


def rate_class(rate: Column, low: float, high: float, zero: str | None = None) -> Column:
    """Traffic-light class of a percentage."""
    out = F.when(rate == 0, zero) if zero is not None else None
    first = (rate < low, "low")
    out = out.when(*first) if out is not None else F.when(*first)
    return out.when(rate < high, "mid").otherwise("high")


def cohort_refund(df: DataFrame, periods: DataFrame, n: int = 30) -> DataFrame:
    """Per pay day of a group: orders and those refunded by start+n, with a rate class."""
    cutoff = plus_days("start_date", n)
    days = (
        group_period(df, periods)
        .groupBy("grp", F.datediff(F.to_date("pay_time"), "start_date").alias("day_offset"))
        .agg(F.count("*").alias("orders"), count_if(F.col("refund_time") <= cutoff).alias("refunds"))
        .where(F.col("day_offset").between(0, n))
    )
    rate = ratio(F.col("refunds"), F.col("orders")) * 100
    return days.select(
        "grp", "day_offset", "orders", "refunds", rate.alias("refund_rate_pct"), rate_class(rate, 10, 20, "none").alias("rate_class")
    )


def cohort_refund_aligned(df: DataFrame, periods: DataFrame, target: str) -> DataFrame:
    """The same per period slice, all launches observed up to the target's latest relative pay day."""
    # days, rounded up, after which a refund is seen: the observed day is known from the counts only
    start = F.col("start_date").cast("timestamp")
    seen_after = F.ceil((micros("refund_time") - micros(start)) / F.lit(86_400_000_000.0))
    offset = F.datediff(F.to_date("pay_time"), "start_date")
    by = ["period", "day_offset", "_after"]
    daily = cut_lineage(period_slice(df, periods).select("period", offset.alias("day_offset"), seen_after.alias("_after")).groupBy(*by).agg(F.count("*").alias("n")))
    observed = daily.where(F.col("period") == target).agg(F.max("day_offset").alias("_obs"))
    refunds = F.coalesce(F.sum(F.when(F.col("_after") <= F.col("_obs"), F.col("n"))), F.lit(0))
    days = daily.withColumn("_obs", observed.scalar()).groupBy("period", "day_offset").agg(F.sum("n").alias("orders"), refunds.alias("refunds"))
    return days.select(
        "period", "day_offset", "orders", "refunds", (ratio(F.col("refunds"), F.col("orders")) * 100).alias("refund_rate_pct")
    )


def refund_curve(df: DataFrame, periods: DataFrame, n: int = 30) -> DataFrame:
    """Refunds per day 1..n from start, cumulative."""
    days = _daily(df, "refund_time", periods, daily_refunds=F.count("*")).withColumn("day", day_index("date", "start_date"))
    kept = days.where(F.col("day").between(1, n))
    return kept.select(
        "grp", "date", "day", "daily_refunds",
        F.sum("daily_refunds").over(_by("grp").orderBy("day").rowsBetween(UP, 0)).alias("cumulative_refunds"),
    )


def refund_rate_curve(df: DataFrame, periods: DataFrame, n: int = 30) -> DataFrame:
    """Dense days 1..n, running orders and refunds carried forward, rate in percent."""
    orders = daily_curve(df, periods).select("grp", "day", "cumulative_orders")
    refunds = refund_curve(df, periods, n).select("grp", "day", "cumulative_refunds")
    grid = orders.select("grp").distinct().select("grp", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("day"))
    joined = grid.join(orders, ["grp", "day"], "left").join(refunds, ["grp", "day"], "left")
    upto = _by("grp").orderBy("day").rowsBetween(UP, 0)
    carry = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(0))
    return joined.select(
        "grp", "day", carry("cumulative_orders").alias("cumulative_orders"), carry("cumulative_refunds").alias("cumulative_refunds")
    ).withColumn("refund_rate_pct", ratio(F.col("cumulative_refunds"), F.col("cumulative_orders")) * 100)


def conversion_by_day(df: DataFrame, periods: DataFrame, n: int = 1) -> DataFrame:
    """Per presale pay day: orders, those locked before end+n, and the rate."""
    days = (
        group_period(df, periods)
        .groupBy("grp", "start_date", "end_date", F.to_date("pay_time").alias("date"))
        .agg(F.count("*").alias("total"), count_if(F.col("lock_time") < plus_days("end_date", n)).alias("locks"))
        .where(F.col("date").between(F.col("start_date"), F.col("end_date")))
    )
    return days.select(
        "grp", day_index("date", "start_date").alias("day"), "locks", "total",
        (ratio(F.col("locks"), F.col("total")) * 100).alias("conversion_pct"),
    )


def daily_change_table(df: DataFrame, periods: DataFrame, groups: Sequence[str], n: int = 1) -> DataFrame:
    """Orders, running orders, locks and conversion by day, one column set per group."""
    days = conversion_by_day(df, periods, n)
    upto = _by("grp").orderBy("day").rowsBetween(UP, 0)
    joined = days.select(
        "grp", "day", F.col("total").alias("orders"), F.sum("total").over(upto).alias("cum_orders"), "locks", "conversion_pct"
    )
    return wide(joined.where(F.col("grp").isin(list(groups))), "day", groups, ["orders", "cum_orders", "locks", "conversion_pct"])


def _lock_days(df: DataFrame, periods: DataFrame, **extra: Column) -> DataFrame:
    """Locks per (grp, day from end); extra conditional counts are taken in the same pass."""
    locked = group_period(df.where(F.col("lock_time").isNotNull()), periods)
    return locked.groupBy("grp", "end_date", F.to_date("lock_time").alias("date")).agg(
        F.count("*").alias("daily_locks"), *[count_if(c).alias(k) for k, c in extra.items()]
    ).withColumn("day", days_from_end("date", "end_date"))


def lock_curve(df: DataFrame, periods: DataFrame, n: int = 30) -> DataFrame:
    """Locks per day 0..n after the end, cumulative from day 0; days without a lock are not emitted."""
    days = _lock_days(df, periods).where(F.col("day").between(0, n))
    return days.select(
        "grp", "date", "day", "daily_locks",
        F.sum("daily_locks").over(_by("grp").orderBy("day").rowsBetween(UP, 0)).alias("cumulative_locks"),
    )


def lock_change(curve: DataFrame) -> DataFrame:
    """% change against the previous emitted day, 0 where there is none."""
    prev = F.lag("daily_locks").over(_by("grp").orderBy("day"))
    return curve.withColumn("prev_daily_locks", prev.cast("double")).withColumn(
        "change_pct", F.coalesce(rel_change(F.col("daily_locks"), F.col("prev_daily_locks")) * 100, F.lit(0.0))
    )


def lock_conversion_curve(df: DataFrame, periods: DataFrame, n: int = 30) -> DataFrame:
    """Running locks of orders paid by the end over presale orders; accumulated before the 0..n filter."""
    joined = group_period(df, periods)
    counted = F.col("lock_time").isNotNull() & (F.col("pay_time") <= midnight("end_date"))
    per_day = joined.groupBy("grp", "end_date", F.to_date(F.when(counted, F.col("lock_time"))).alias("date")).agg(
        F.count("*").alias("daily_locks"), count_if(in_period("pay_time")).alias("_presale")
    )
    totals = F.sum("_presale").over(_by("grp"))
    days = per_day.withColumn("_total", totals).where(F.col("date").isNotNull())
    cum = F.sum("daily_locks").over(_by("grp").orderBy("date").rowsBetween(UP, 0))
    return (
        days.withColumn("cumulative_locks", cum)
        .withColumn("day", days_from_end("date", "end_date"))
        .where(F.col("day").between(0, n))
        .select(
            "grp", "date", "day", "daily_locks", "cumulative_locks",
            (ratio(F.col("cumulative_locks"), F.col("_total")) * 100).alias("conversion_pct"),
        )
    )


def lock_performance(df: DataFrame, periods: DataFrame, n: int = 30) -> DataFrame:
    """Dense days 0..n after the end: locks, running locks, and those paid by / after the end day."""
    paid = F.to_date("pay_time")
    days = _lock_days(
        df, periods, retained_locks=paid <= F.col("end_date"), post_launch_locks=paid > F.col("end_date")
    ).where(F.col("day").between(0, n))
    present = df.select("grp").distinct()
    grid = group_period(present, periods).select("grp", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("day"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = grid.join(days, ["grp", "day"], "left").select(
        "grp", "day", zero("daily_locks"), zero("retained_locks"), zero("post_launch_locks")
    )
    return joined.withColumn(
        "cumulative_locks", F.sum("daily_locks").over(_by("grp").orderBy("day").rowsBetween(UP, 0))
    )


def post_launch_locks(df: DataFrame, periods: DataFrame, target: str, as_of: str) -> DataFrame:
    """Locks on day N after the end and over days 0..N for every launch, N being the target's day before as_of.

    Nothing is returned while the target has no locks.
    """
    n_days = (
        periods.where(F.col("grp") == target)
        .select(F.datediff(F.lit(as_of).cast("date"), "end_date") - 1)
    )
    sliced = period_slice(df, periods).withColumn("n_days", n_days.scalar())
    lock = F.to_date("lock_time")
    last = F.date_add("end_date", F.col("n_days"))
    on_day, upto = lock == last, (lock >= F.col("end_date")) & (lock <= last)
    before = F.col("pay_time") < midnight("end_date")
    stats = sliced.groupBy("period", "n_days", last.alias("lock_date")).agg(
        count_if(on_day).alias("locks_on_day"),
        count_if(on_day & before).alias("retained_on_day"),
        count_if(upto).alias("cum_locks"),
        count_if(upto & before).alias("cum_retained"),
        count_if(lock.isNotNull() & (F.col("period") == target)).alias("_any"),
    )
    started = F.max("_any").over(Window.partitionBy(F.lit(0)))  # one row per launch
    return stats.withColumn("_started", started).where(F.col("_started") > 0).drop("_any", "_started")


def moving_avg(metrics: DataFrame, cols: Sequence[str], n: int = 7, by: Sequence[str] = (), order: str = "date") -> DataFrame:
    """Trailing means over n observed rows of a daily table, shorter at the start."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(-(n - 1), 0)
    return metrics.select("*", *[F.avg(c).over(w).alias(f"{c}_ma{n}") for c in cols])


def delivery_curve(df: DataFrame, lo: str, hi: str, n: int = 7) -> DataFrame:
    """Deliveries and mean invoice price per group and day, with trailing means over n delivery days."""
    t = F.col("invoice_time")
    days = (
        df.where((t >= F.lit(lo).cast("timestamp")) & (t <= F.lit(hi).cast("timestamp")) & F.col("grp").isNotNull())
        .groupBy("grp", F.to_date(t).alias("date"))
        .agg(F.count("order_id").alias("deliveries"), F.avg("invoice_price").alias("mean_price"))
    )
    return moving_avg(days, ["deliveries", "mean_price"], n, by=["grp"])


def delivery_summary(curve: DataFrame) -> DataFrame:
    """Totals over the curve; the mean price is the mean of daily means, not weighted by orders."""
    return curve.agg(
        F.sum("deliveries").alias("deliveries"),
        F.avg("mean_price").alias("mean_of_daily_prices"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.count("*").alias("points"),
    )


def daily_pair_series(df: DataFrame, periods: DataFrame, n: int = 30) -> DataFrame:
    """Dense days start..end+n-1: pays inside the period and locks in [end, end+n)."""
    pay, lock = F.col("pay_time"), F.col("lock_time")
    events = F.array(
        F.struct(F.to_date(F.when(in_period("pay_time"), pay)).alias("date"), F.lit(1).alias("p"), F.lit(0).alias("l")),
        F.struct(
            F.to_date(F.when((lock >= midnight("end_date")) & (lock < plus_days("end_date", n)), lock)).alias("date"),
            F.lit(0).alias("p"),
            F.lit(1).alias("l"),
        ),
    )
    days = (
        group_period(df, periods)
        .select("grp", F.inline(events))
        .where(F.col("date").isNotNull())
        .groupBy("grp", "date")
        .agg(F.sum("p").alias("pays"), F.sum("l").alias("locks"))
    )
    grid = periods.select("grp", F.explode(F.sequence("start_date", F.date_add("end_date", n - 1))).alias("date"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return grid.join(days, ["grp", "date"], "left").select("grp", "date", zero("pays"), zero("locks"))


def cross_corr(series: DataFrame, max_lag: int = 14) -> DataFrame:
    """corr(pays[t], locks[t+lag]) for lag 0..max_lag; null below three points or without variance."""
    w = _by("grp").orderBy("date")
    pairs = F.array(
        *[F.struct(F.lit(k).alias("lag"), F.col("pays").cast("double").alias("x"), F.lead("locks", k).over(w).cast("double").alias("y")) for k in range(max_lag + 1)]
    )
    rows = series.select("grp", pairs.alias("_p")).select("grp", F.inline("_p")).where(F.col("y").isNotNull())
    ok = (F.count("*") >= 3) & (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    return rows.groupBy("grp", "lag").agg(F.when(ok, F.corr("x", "y")).alias("corr"))


def peak_lag(corrs: DataFrame) -> DataFrame:
    """Lag of the highest correlation per group, the smallest lag on a tie."""
    best = F.max_by(F.struct("lag", "corr"), F.when(F.col("corr").isNotNull(), F.struct(F.col("corr"), -F.col("lag"))))
    return corrs.groupBy("grp").agg(best.alias("_b")).select("grp", F.col("_b.lag").alias("lag"), F.col("_b.corr").alias("corr"))


def interp_grid(points: DataFrame, grid: DataFrame, by: str = "grp", x: str = "day", y: str = "rate") -> DataFrame:
    """Piecewise-linear value of (x, y) points at grid positions; flat outside the points."""
    facts = points.select(F.col(by), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(0).alias("_q"))
    asks = grid.select(F.col(by), F.col(x).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(1).alias("_q"))
    w = _by(by).orderBy("x", "_q")
    known_x = F.when(F.col("_q") == 0, F.col("x"))
    back, ahead = w.rowsBetween(UP, 0), w.rowsBetween(0, Window.unboundedFollowing)
    rows = facts.unionByName(asks).select(
        by, "x", "_q",
        F.last(known_x, ignorenulls=True).over(back).alias("x0"), F.last("y", ignorenulls=True).over(back).alias("y0"),
        F.first(known_x, ignorenulls=True).over(ahead).alias("x1"), F.first("y", ignorenulls=True).over(ahead).alias("y1"),
    ).where(F.col("_q") == 1)
    slope = F.try_divide(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    inner = F.col("y0") + F.coalesce(slope, F.lit(0.0)) * (F.col("x") - F.col("x0"))
    return rows.select(by, F.col("x").alias(x), F.coalesce(inner, F.col("y0"), F.col("y1")).alias(y))
