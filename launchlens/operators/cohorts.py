"""Per-launch funnels, window summaries and intervals. One conditional aggregation each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from launchlens.functions.semantics import bucket, count_if, in_period, interval_days, midnight, plus_days, ratio
from launchlens.operators.periods import exclude_groups, group_period, lock_window_filter, period_slice, presale
from launchlens.plans.selection import count_stats, counted_moments, exact_quantiles, value_counts
from launchlens.plans.skew import range_join


def _every_period(periods: DataFrame, agg: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Periods without any order keep a row of zeros."""
    joined = periods.join(agg, "grp", "left")
    return joined.select("grp", "start_date", "end_date", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts])


def launch_summary(df: DataFrame, periods: DataFrame, n: int = 1) -> DataFrame:
    """Presale days and orders, locks on calendar days [end, end+n], retained / post-launch split."""
    pay, lock = F.to_date("pay_time"), F.to_date("lock_time")
    in_window = (lock >= F.col("end_date")) & (lock <= F.date_add("end_date", n))
    agg = group_period(df, periods).groupBy("grp").agg(
        count_if(pay <= F.col("end_date")).alias("presale_orders"),
        count_if(in_window).alias("locks"),
        count_if(in_window & (pay <= F.col("end_date"))).alias("retained_locks"),
        count_if(in_window & (pay > F.col("end_date"))).alias("post_launch_locks"),
    )
    out = _every_period(periods, agg, ["presale_orders", "locks", "retained_locks", "post_launch_locks"])
    return out.select(
        "grp",
        (F.datediff("end_date", "start_date") + 1).alias("presale_days"),
        "presale_orders",
        "locks",
        "retained_locks",
        "post_launch_locks",
        (ratio(F.col("retained_locks"), F.col("presale_orders")) * 100).alias("conversion_pct"),
    )


def _start_conditions(n: int) -> dict[str, Column]:
    pay, refund = F.col("pay_time"), F.col("refund_time")
    lo, hi = midnight("start_date"), plus_days("start_date", n)
    return {
        "pays": (pay >= lo) & (pay < hi),
        "refunds": (refund >= lo) & (refund < hi) & (pay < refund),
        "pays_full": in_period("pay_time"),
    }


def window_start_summary(df: DataFrame, periods: DataFrame, n: int = 3) -> DataFrame:
    """Pays and refunds in [start, start+n), pays of the whole period, refund share. Every period kept."""
    cond = _start_conditions(n)
    agg = group_period(df, periods).groupBy("grp").agg(*[count_if(c).alias(k) for k, c in cond.items()])
    out = _every_period(periods, agg, list(cond))
    return out.select(
        "grp", *cond, (ratio(F.col("refunds"), F.col("pays"), None) * 100).alias("refund_to_pay_pct")
    )


def _lock_conditions(n: int) -> dict[str, Column]:
    pay, refund, lock, deposit = (F.col(c) for c in ("pay_time", "refund_time", "lock_time", "deposit_time"))
    start, end, until = midnight("start_date"), midnight("end_date"), plus_days("end_date", n)
    locked = (lock >= end) & (lock < until)
    deposited = F.coalesce((deposit >= end) & (deposit < until), F.lit(False))
    paid_ext = F.coalesce((pay >= start) & (pay < until), F.lit(False))
    paid = in_period("pay_time")
    return {
        "locks": locked,
        "deposits": deposited,
        "deposit_or_pay": deposited | paid_ext,
        "pays_full": paid,
        "retained_locks": paid & locked,
        "refunds": paid & (refund < until) & (pay < refund),
    }


def window_lock_summary(df: DataFrame, periods: DataFrame, n: int = 3) -> DataFrame:
    """Locks, deposits and retained locks in [end, end+n), refunds before end+n, and their rates."""
    cond = _lock_conditions(n)
    agg = group_period(df, periods).groupBy("grp").agg(*[count_if(c).alias(k) for k, c in cond.items()])
    out = _every_period(periods, agg, list(cond))
    return _lock_rates(out, ["grp", *cond])


def _lock_rates(out: DataFrame, cols: Sequence[str]) -> DataFrame:
    return out.select(
        *cols,
        (ratio(F.col("retained_locks"), F.col("pays_full"), None) * 100).alias("conversion_pct"),
        (ratio(F.col("refunds"), F.col("pays_full"), None) * 100).alias("refund_pct"),
    )


def window_sweep(df: DataFrame, periods: DataFrame, ns: Sequence[int]) -> DataFrame:
    """Both window summaries for every n in ns, reading the orders once.

    Each order is counted under the smallest n from which it qualifies; only these
    per-group counts are widened to all n.
    """
    pay, refund, lock, deposit = (F.col(c) for c in ("pay_time", "refund_time", "lock_time", "deposit_time"))
    start, end = midnight("start_date"), midnight("end_date")
    from_start = lambda t: F.greatest(interval_days(start, t) + 1, F.lit(1))
    from_end = lambda t: F.greatest(interval_days(end, t) + 1, F.lit(1))
    paid = in_period("pay_time")
    locked = lock >= end
    first_n = {
        "start_pays": F.when(pay >= start, from_start(pay)),
        "start_refunds": F.when((refund >= start) & (pay < refund), from_start(refund)),
        "locks": F.when(locked, from_end(lock)),
        "deposits": F.when(deposit >= end, from_end(deposit)),
        "deposit_or_pay": F.least(F.when(deposit >= end, from_end(deposit)), F.when(pay >= start, from_end(pay))),
        "retained_locks": F.when(paid & locked, from_end(lock)),
        "refunds": F.when(paid & (pay < refund), from_end(refund)),
        "pays_full": F.when(paid, F.lit(1)),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("long").alias("first_n")) for k, v in first_n.items()])
    counts = (
        group_period(df, periods)
        .select("grp", F.inline(entries))
        .where(F.col("first_n").isNotNull())
        .groupBy("grp", "metric", "first_n")
        .agg(F.count("*").alias("c"))
    )
    grid = periods.select("grp", F.explode(F.array(*[F.lit(n) for n in ns])).alias("n"))
    reach = grid.join(counts, "grp", "left").where(F.col("first_n").isNull() | (F.col("first_n") <= F.col("n")))
    wide = grid.join(
        reach.groupBy("grp", "n").agg(
            *[F.sum(F.when(F.col("metric") == k, F.col("c"))).alias(k) for k in first_n]
        ),
        ["grp", "n"],
        "left",
    )
    wide = wide.select("grp", "n", *[F.coalesce(F.col(k), F.lit(0)).alias(k) for k in first_n])
    out = _lock_rates(wide, ["grp", "n", *first_n])
    return out.withColumn("refund_to_pay_pct", ratio(F.col("start_refunds"), F.col("start_pays"), None) * 100)


def presale_summary(df: DataFrame, periods: DataFrame, lock_days: int = 1) -> DataFrame:
    """Presale total, locks before end+lock_days, conversion, daily mean and peak (earliest on a tie)."""
    retained = F.col("lock_time") < plus_days("end_date", lock_days)
    daily = (
        presale(df, periods)
        .groupBy("grp", "start_date", "end_date", F.to_date("pay_time").alias("date"))
        .agg(F.count("*").alias("orders"), count_if(retained).alias("locks"))
    )
    days = F.datediff("end_date", "start_date") + 1
    return daily.groupBy("grp", "start_date", "end_date").agg(
        F.sum("orders").alias("presale_orders"),
        F.sum("locks").alias("retained_locks"),
        F.max("orders").alias("peak_orders"),
        F.max_by("date", F.struct(F.col("orders"), -F.unix_date("date"))).alias("peak_date"),
    ).select(
        "grp",
        days.alias("presale_days"),
        "presale_orders",
        "retained_locks",
        (ratio(F.col("retained_locks"), F.col("presale_orders")) * 100).alias("conversion_pct"),
        ratio(F.col("presale_orders"), days).alias("avg_daily_orders"),
        "peak_orders",
        "peak_date",
    )


# Bands of whole days from payment to lock, both ends inclusive.
LOCK_INTERVAL_BANDS = (
    (0, 0, "0"), (1, 3, "1-3"), (4, 7, "4-7"), (8, 14, "8-14"), (15, 30, "15-30"), (31, 60, "31-60"), (61, 365, "61+"),
)


def _lock_interval_counts(df: DataFrame, periods: DataFrame, lock_days: int) -> tuple[DataFrame, DataFrame]:
    orders = presale(df, periods)
    days = interval_days("pay_time", "lock_time")
    locked = F.col("lock_time") < plus_days("end_date", lock_days)
    kept = F.when(locked & (days >= 0) & (days <= 365), days)
    counts = orders.groupBy("grp", kept.alias("days")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("grp").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("days").isNotNull(), F.col("n"))), F.lit(0)).alias("locked")
    )
    return counts.where(F.col("days").isNotNull()), totals


def lock_interval_bands(df: DataFrame, periods: DataFrame, lock_days: int = 1) -> DataFrame:
    """Orders per band of days from payment to lock, as % of locked and of all presale orders; launches without locks have zeros."""
    counts, totals = _lock_interval_counts(df, periods, lock_days)
    edges = [b[0] for b in LOCK_INTERVAL_BANDS] + [366]
    labels = [b[2] for b in LOCK_INTERVAL_BANDS]
    banded = counts.groupBy("grp", bucket("days", edges, labels).alias("band")).agg(F.sum("n").alias("n"))
    all_bands = F.explode(F.array(*[F.lit(x) for x in labels])).alias("band")
    grid = totals.select("grp", "total", "locked", all_bands)
    n = F.coalesce(F.col("n"), F.lit(0))
    return grid.join(banded, ["grp", "band"], "left").select(
        "grp",
        "band",
        n.alias("n"),
        (ratio(n, F.col("locked")) * 100).alias("pct_of_locked"),
        (ratio(n, F.col("total")) * 100).alias("pct_of_total"),
    )


def lock_interval_stats(df: DataFrame, periods: DataFrame, lock_days: int = 1) -> DataFrame:
    """Descriptive statistics of the same intervals with ranks by mean interval and by lock rate."""
    counts, totals = _lock_interval_counts(df, periods, lock_days)
    stats = totals.join(count_stats(counts, ["grp"], "days"), "grp", "left")
    rate = ratio(F.col("locked"), F.col("total")) * 100
    everything = Window.partitionBy(F.lit(0))  # one row per launch
    return stats.select(
        "grp", "total", "locked", rate.alias("lock_rate_pct"), "mean", "median", "std_samp", "min", "max", "q25", "q75"
    ).select(
        "*",
        F.rank().over(everything.orderBy(F.col("mean").desc_nulls_last())).alias("rank_by_mean"),
        F.rank().over(everything.orderBy(F.col("lock_rate_pct").desc())).alias("rank_by_lock_rate"),
    )


def launch_ranking(summary: DataFrame, intervals: DataFrame) -> DataFrame:
    """Best and worst conversion, most orders, fastest and slowest mean lock interval. Ties go to the first name."""
    j = summary.select("grp", "conversion_pct", "presale_orders").join(intervals.select("grp", "mean"), "grp", "left")
    first = lambda v, sign: F.min_by("grp", F.when(v.isNotNull(), F.struct(v * sign, F.col("grp"))))
    return j.agg(
        first(F.col("conversion_pct"), -1).alias("best_conversion"),
        first(F.col("conversion_pct"), 1).alias("worst_conversion"),
        first(F.col("presale_orders"), -1).alias("most_orders"),
        first(F.col("mean"), 1).alias("fastest_lock"),
        first(F.col("mean"), -1).alias("slowest_lock"),
    )


DEPTH_FROM = {
    "create": "create_time",
    "pay": "pay_time",
    "assign": "assign_time",
    "touch": "touch_time",
}


def lock_depth_rows(df: DataFrame, periods: DataFrame, n: int = 30, exclude: Sequence[str] = ()) -> DataFrame:
    """Long (grp, metric, days): fractional days from each earlier event to the lock."""
    kept = lock_window_filter(exclude_groups(df, exclude), periods, n)
    metrics = {m: c for m, c in DEPTH_FROM.items() if c in df.columns}
    structs = [
        F.struct(F.lit(m).alias("metric"), interval_days(c, "lock_time", whole=False).alias("days"))
        for m, c in metrics.items()
    ]
    return kept.select("grp", F.inline(F.array(*structs)))


def lock_depth(df: DataFrame, periods: DataFrame, n: int = 30, exclude: Sequence[str] = ()) -> DataFrame:
    """Locks, mean, std and exact median of the days before the lock, from one read of the orders."""
    by = ["grp", "metric"]
    counts = value_counts(lock_depth_rows(df, periods, n, exclude), by, "days")
    stats = counted_moments(counts, by).select(*by, F.col("rows").alias("locks"), F.col("count").alias("n"), "mean", F.col("std_samp").alias("std"))
    med = exact_quantiles(counts, by, "v", [0.5], weight="n").withColumnRenamed("q0", "median")
    return stats.join(med, by, "left")


def box_stats(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Box-plot numbers: quartiles, whiskers at the last value inside 1.5 IQR, and what lies beyond."""
    counts = value_counts(rows, by, value)
    q = exact_quantiles(counts, by, "v", [0.25, 0.5, 0.75], weight="n").toDF(*by, "q1", "median", "q3")
    iqr = F.col("q3") - F.col("q1")
    fenced = counts.where(F.col("v").isNotNull()).join(q, list(by))
    inside = (F.col("v") >= F.col("q1") - 1.5 * iqr) & (F.col("v") <= F.col("q3") + 1.5 * iqr)
    return fenced.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
    )


def interval_stats(df: DataFrame, periods: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Statistics of whole-day intervals per period (by pay time), one row per (period, metric)."""
    return interval_stats_by(period_slice(df, periods), ["period"], pairs)


def interval_stats_by(df: DataFrame, by: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    structs = [
        F.struct(F.lit(m).alias("metric"), interval_days(a, b).alias("days")) for m, (a, b) in pairs.items()
    ]
    counts = (
        df.select(*by, F.inline(F.array(*structs)))
        .where(F.col("days").isNotNull())
        .groupBy(*by, "metric", "days")
        .agg(F.count("*").alias("n"))
    )
    return count_stats(counts, [*by, "metric"], "days")


def zscore_outliers(stats: DataFrame, by: str, value: str, limit: float = 2.0, within: Sequence[str] = ()) -> DataFrame:
    """Rows of an aggregated table whose value is more than `limit` population std from the mean, with rank."""
    w = Window.partitionBy(*[F.col(c) for c in within]) if within else Window.partitionBy(F.lit(0))
    scored = stats.select(
        *within,
        by,
        value,
        F.avg(value).over(w).alias("mean_of_groups"),
        F.stddev_pop(value).over(w).alias("std_of_groups"),
        F.rank().over(w.orderBy(F.col(value).asc())).alias("rank"),
    )
    z = ratio(F.abs(F.col(value) - F.col("mean_of_groups")), F.col("std_of_groups"))
    return scored.withColumn("z", z).withColumn("outlier", F.col("z") > limit)


def cycle_counts(df: DataFrame, periods: DataFrame, n: int = 30, exclude: Sequence[str] = ()) -> DataFrame:
    """Pays in [start, end] and locks in [end, end+n) per group; every period kept."""
    lock = F.col("lock_time")
    agg = group_period(exclude_groups(df, exclude), periods).groupBy("grp").agg(
        count_if(in_period("pay_time")).alias("pays"),
        count_if((lock >= midnight("end_date")) & (lock < plus_days("end_date", n))).alias("locks"),
    )
    return _every_period(periods, agg, ["pays", "locks"]).select("grp", "pays", "locks")


def cycle_corr(counts: DataFrame) -> DataFrame:
    """Pearson and Spearman (average ranks) across the rows of cycle_counts."""
    everything = Window.partitionBy(F.lit(0))  # one row per launch
    avg_rank = lambda c: (
        F.rank().over(everything.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / F.lit(2.0)
    )
    ranked = counts.select(
        F.col("pays").cast("double"), F.col("locks").cast("double"), avg_rank("pays").alias("rp"), avg_rank("locks").alias("rl")
    )
    return ranked.agg(F.corr("pays", "locks").alias("pearson"), F.corr("rp", "rl").alias("spearman"))


def period_metric_compare(
    metrics: DataFrame, periods: DataFrame, cols: Sequence[str], days: int = 5, base: Sequence[str] = ()
) -> DataFrame:
    """Sum, mean and day count of daily metrics on [end, end+days), and growth of the mean over base launches."""
    windows = periods.select(
        F.col("grp").alias("period"), F.col("end_date").alias("_from"), F.date_add("end_date", days - 1).alias("_to")
    )
    rows = range_join(metrics.withColumn("_ts", F.col("date").cast("timestamp")), "_ts", windows, "_from", "_to")
    structs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols]
    stats = (
        rows.select("period", "date", F.inline(F.array(*structs)))
        .groupBy("period", "metric")
        .agg(F.sum("v").alias("total"), F.avg("v").alias("daily_mean"), F.count_distinct("date").alias("days"))
    )
    out = stats
    for b in base:
        ref = stats.where(F.col("period") == b).select("metric", F.col("daily_mean").alias(f"_base_{b}"))
        growth = ratio(F.col("daily_mean") - F.col(f"_base_{b}"), F.col(f"_base_{b}"), None) * 100
        out = out.join(ref, "metric", "left").withColumn(f"growth_vs_{b}", growth).drop(f"_base_{b}")
    return out
