"""Queries over launch funnels, windows and intervals, with their oracles."""

from __future__ import annotations

from launchlens.catalog.bindings import (
    N_EVENTS, N_ORDERS, SQL_DAILY, SQL_EV, SQL_FO, daily_metrics, event_periods, fact_events, fact_orders, order_periods,
)
from launchlens.catalog.registry import d, div, query, r, whole_days
from launchlens.functions.semantics import interval_days
from launchlens.operators import cohorts as co
from launchlens.operators import periods as pr
from pyspark.sql import functions as F

N = N_ORDERS
TIMES = ("order_id", "grp", "pay_time", "refund_time", "lock_time", "deposit_time")


def fo(spark, sf, *cols):
    return fact_orders(spark, sf, *(cols or TIMES)), order_periods(spark)


def ev(spark, sf):
    return fact_events(spark, sf), event_periods(spark)


PCT = lambda a, b, default="0": r(f"coalesce({div(a, b)}, {default}) * 100")
PCT_NULL = lambda a, b: r(f"{div(a, b)} * 100")


@query("launch_summary", f"""WITH {SQL_FO}, x AS (SELECT p.grp, p.s, p.e,
  count(*) FILTER (CAST(pay_time AS DATE) <= p.e) AS po,
  count(*) FILTER (CAST(lock_time AS DATE) BETWEEN p.e AND p.e + {N}) AS lk,
  count(*) FILTER (CAST(lock_time AS DATE) BETWEEN p.e AND p.e + {N} AND CAST(pay_time AS DATE) <= p.e) AS rl,
  count(*) FILTER (CAST(lock_time AS DATE) BETWEEN p.e AND p.e + {N} AND CAST(pay_time AS DATE) > p.e) AS pl
  FROM p LEFT JOIN fo ON fo.grp = p.grp GROUP BY ALL)
SELECT grp, e - s + 1 AS presale_days, po AS presale_orders, lk AS locks, rl AS retained_locks, pl AS post_launch_locks, {PCT('rl', 'po')} AS conversion_pct FROM x""")
def launch_summary(spark, sf):
    return co.launch_summary(*fo(spark, sf, "grp", "pay_time", "lock_time"), N)


def start_sql(n):
    return f"""count(*) FILTER (pay_time >= p.s AND pay_time < p.s + {n}) AS a,
  count(*) FILTER (refund_time >= p.s AND refund_time < p.s + {n} AND pay_time < refund_time) AS b"""


def lock_sql(n):
    return f"""count(*) FILTER (pay_time >= p.s AND pay_time <= p.e) AS c,
  count(*) FILTER (lock_time >= p.e AND lock_time < p.e + {n}) AS lk,
  count(*) FILTER (deposit_time >= p.e AND deposit_time < p.e + {n}) AS dp,
  count(*) FILTER ((deposit_time >= p.e AND deposit_time < p.e + {n}) OR (pay_time >= p.s AND pay_time < p.e + {n})) AS un,
  count(*) FILTER (pay_time >= p.s AND pay_time <= p.e AND lock_time >= p.e AND lock_time < p.e + {n}) AS rl,
  count(*) FILTER (pay_time >= p.s AND pay_time <= p.e AND refund_time < p.e + {n} AND pay_time < refund_time) AS rf"""


@query("window_start_summary", f"""WITH {SQL_FO}, x AS (SELECT p.grp, {start_sql(60)}, {lock_sql(60)} FROM p LEFT JOIN fo ON fo.grp = p.grp GROUP BY ALL)
SELECT grp, a AS pays, b AS refunds, c AS pays_full, {PCT_NULL('b', 'a')} AS refund_to_pay_pct FROM x""")
def window_start_summary(spark, sf):
    return co.window_start_summary(*fo(spark, sf), 60)


@query("window_lock_summary", f"""WITH {SQL_FO}, x AS (SELECT p.grp, {lock_sql(N)} FROM p LEFT JOIN fo ON fo.grp = p.grp GROUP BY ALL)
SELECT grp, lk AS locks, dp AS deposits, un AS deposit_or_pay, c AS pays_full, rl AS retained_locks, rf AS refunds,
{PCT_NULL('rl', 'c')} AS conversion_pct, {PCT_NULL('rf', 'c')} AS refund_pct FROM x""")
def window_lock_summary(spark, sf):
    return co.window_lock_summary(*fo(spark, sf), N)


SWEEP = (1, 3, 7, 30, 60, 180)


@query("window_sweep", f"""WITH {SQL_FO}, k AS (SELECT unnest({list(SWEEP)}) AS n), x AS (SELECT p.grp, k.n, {start_sql('CAST(k.n AS INTEGER)')}, {lock_sql('CAST(k.n AS INTEGER)')}
  FROM p CROSS JOIN k LEFT JOIN fo ON fo.grp = p.grp GROUP BY ALL)
SELECT grp, n, a AS start_pays, b AS start_refunds, lk AS locks, dp AS deposits, un AS deposit_or_pay, rl AS retained_locks, rf AS refunds, c AS pays_full,
{PCT_NULL('rl', 'c')} AS conversion_pct, {PCT_NULL('rf', 'c')} AS refund_pct, {PCT_NULL('b', 'a')} AS refund_to_pay_pct FROM x""")
def window_sweep(spark, sf):
    return co.window_sweep(*fo(spark, sf), SWEEP)


PRESALE = f"""
pz0 AS (SELECT grp, s, e, CAST(pay_time AS DATE) AS dt, count(*) AS n, count(*) FILTER (lock_time < e + {N}) AS lk FROM gp WHERE pay_time >= s AND pay_time <= e GROUP BY ALL),
pz AS (SELECT grp, e - s + 1 AS dn, CAST(sum(n) AS BIGINT) AS po, CAST(sum(lk) AS BIGINT) AS rl, max(n) AS pk FROM pz0 GROUP BY ALL),
pk AS (SELECT grp, dt AS pkd FROM pz0 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, dt) = 1)
"""


@query("presale_summary", f"""WITH {SQL_FO}, {PRESALE} SELECT pz.grp, dn AS presale_days, po AS presale_orders, rl AS retained_locks, {PCT('rl', 'po')} AS conversion_pct,
{r('po / dn')} AS avg_daily_orders, pk AS peak_orders, {d('pkd')} AS peak_date FROM pz JOIN pk ON pk.grp = pz.grp""")
def presale_summary(spark, sf):
    return co.presale_summary(*fo(spark, sf, "grp", "pay_time", "lock_time"), N)


INTERVALS = f"""
iv0 AS (SELECT grp, CASE WHEN lock_time < e + {N} THEN {whole_days('pay_time', 'lock_time')} END AS dd FROM gp WHERE pay_time >= s AND pay_time <= e),
iv AS (SELECT grp, CASE WHEN dd BETWEEN 0 AND 365 THEN dd END AS dd FROM iv0),
it AS (SELECT grp, count(*) AS total, count(dd) AS locked FROM iv GROUP BY 1)
"""

BANDS_SQL = ", ".join(f"({lo}, {hi}, '{b}')" for lo, hi, b in co.LOCK_INTERVAL_BANDS)


@query("lock_interval_bands", f"""WITH {SQL_FO}, {INTERVALS}, b AS (SELECT * FROM (VALUES {BANDS_SQL}) AS t(lo, hi, band)),
x AS (SELECT it.grp, b.band, total, locked, (SELECT count(*) FROM iv WHERE iv.grp = it.grp AND dd BETWEEN lo AND hi) AS n FROM it, b)
SELECT grp, band, n, {PCT('n', 'locked')} AS pct_of_locked, {PCT('n', 'total')} AS pct_of_total FROM x""")
def lock_interval_bands(spark, sf):
    return co.lock_interval_bands(*fo(spark, sf, "grp", "pay_time", "lock_time"), N)


@query("lock_interval_stats", f"""WITH {SQL_FO}, {INTERVALS}, x AS (SELECT it.grp, total, locked, locked / total * 100 AS lr, avg(dd) AS m, median(dd) AS md,
  CASE WHEN count(dd) > 0 THEN coalesce(stddev_samp(dd), 0) END AS sd, min(dd) AS mn, max(dd) AS mx, quantile_cont(dd, 0.25) AS a, quantile_cont(dd, 0.75) AS b
  FROM it LEFT JOIN iv ON it.grp = iv.grp AND dd IS NOT NULL GROUP BY it.grp, total, locked)
SELECT grp, total, locked, {r('lr')} AS lock_rate_pct, {r('m')} AS mean, {r('md')} AS median, {r('sd')} AS std_samp, {r('mn')} AS min, {r('mx')} AS max, {r('a')} AS q25, {r('b')} AS q75,
rank() OVER (ORDER BY m DESC) AS rank_by_mean, rank() OVER (ORDER BY lr DESC) AS rank_by_lock_rate FROM x""")
def lock_interval_stats(spark, sf):
    return co.lock_interval_stats(*fo(spark, sf, "grp", "pay_time", "lock_time"), N)


@query("launch_ranking", f"""WITH {SQL_FO}, {PRESALE}, {INTERVALS}, x AS (SELECT pz.grp, coalesce(rl / po, 0) AS cv, po, (SELECT avg(dd) FROM iv WHERE iv.grp = pz.grp) AS m FROM pz)
SELECT (SELECT grp FROM x ORDER BY cv DESC, grp LIMIT 1) AS best_conversion, (SELECT grp FROM x ORDER BY cv, grp LIMIT 1) AS worst_conversion,
(SELECT grp FROM x ORDER BY po DESC, grp LIMIT 1) AS most_orders, (SELECT grp FROM x WHERE m IS NOT NULL ORDER BY m, grp LIMIT 1) AS fastest_lock,
(SELECT grp FROM x WHERE m IS NOT NULL ORDER BY m DESC, grp LIMIT 1) AS slowest_lock""")
def launch_ranking(spark, sf):
    o, p = fo(spark, sf, "grp", "pay_time", "lock_time")
    return co.launch_ranking(co.presale_summary(o, p, N), co.lock_interval_stats(o, p, N))


DEPTH = f"""
dr AS (SELECT grp, unnest(['pay', 'assign']) AS metric, unnest([(epoch_us(lock_time) - epoch_us(pay_time)) / 86400000000.0, (epoch_us(lock_time) - epoch_us(assign_time)) / 86400000000.0]) AS dd
  FROM gp WHERE lock_time >= e AND lock_time < e + {N_EVENTS} AND grp <> 'G3')
"""


@query("lock_depth", f"""WITH {SQL_EV}, {DEPTH} SELECT grp, metric, count(*) AS locks, count(dd) AS n, {r('avg(dd)')} AS mean, {r('stddev_samp(dd)')} AS std, {r('median(dd)')} AS median FROM dr GROUP BY ALL""")
def lock_depth(spark, sf):
    return co.lock_depth(*ev(spark, sf), N_EVENTS, ["g-3"])


@query("lock_depth_box", f"""WITH {SQL_EV}, {DEPTH}, q AS (SELECT grp, metric, quantile_cont(dd, 0.25) AS a, quantile_cont(dd, 0.5) AS m, quantile_cont(dd, 0.75) AS b FROM dr GROUP BY ALL)
SELECT q.grp, q.metric, {r('a')} AS q1, {r('m')} AS median, {r('b')} AS q3,
{r('min(dd) FILTER (dd BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))')} AS whisker_low, {r('max(dd) FILTER (dd BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))')} AS whisker_high,
count(*) FILTER (NOT dd BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS outliers FROM dr JOIN q ON q.grp = dr.grp AND q.metric = dr.metric WHERE dd IS NOT NULL GROUP BY q.grp, q.metric, a, m, b""")
def lock_depth_box(spark, sf):
    return co.box_stats(co.lock_depth_rows(*ev(spark, sf), N_EVENTS, ["g-3"]), ["grp", "metric"], "days")


EV_PAIRS = {"pay_to_refund": ("pay_time", "refund_time"), "pay_to_assign": ("pay_time", "assign_time")}
ISTAT = f"""
ir AS (SELECT period, unnest(['pay_to_refund', 'pay_to_assign']) AS metric, unnest([{whole_days('pay_time', 'refund_time')}, {whole_days('pay_time', 'assign_time')}]) AS dd FROM ps),
st AS (SELECT period, metric, count(dd) AS n, avg(dd) AS m, median(dd) AS md, stddev_pop(dd) AS sp, coalesce(stddev_samp(dd), 0) AS ss, min(dd) AS mn, max(dd) AS mx,
  quantile_cont(dd, 0.25) AS a, quantile_cont(dd, 0.75) AS b FROM ir WHERE dd IS NOT NULL GROUP BY ALL)
"""


@query("interval_stats", f"""WITH {SQL_EV}, {ISTAT} SELECT period, metric, n AS count, {r('m')} AS mean, {r('md')} AS median, {r('sp')} AS std, {r('ss')} AS std_samp,
{r('mn')} AS min, {r('mx')} AS max, {r('a')} AS q25, {r('b')} AS q75 FROM st""")
def interval_stats(spark, sf):
    return co.interval_stats(*ev(spark, sf), EV_PAIRS)


@query("interval_outliers", f"""WITH {SQL_EV}, {ISTAT}, x AS (SELECT metric, period, m, avg(m) OVER w AS mg, stddev_pop(m) OVER w AS sg, rank() OVER (PARTITION BY metric ORDER BY m) AS rk
  FROM st WINDOW w AS (PARTITION BY metric))
SELECT metric, period, {r('m')} AS mean, {r('mg')} AS mean_of_groups, {r('sg')} AS std_of_groups, rk AS rank, {r('coalesce(' + div('abs(m - mg)', 'sg') + ', 0)')} AS z,
coalesce({div('abs(m - mg)', 'sg')}, 0) > 1.5 AS outlier FROM x""")
def interval_outliers(spark, sf):
    return co.zscore_outliers(co.interval_stats(*ev(spark, sf), EV_PAIRS), "period", "mean", 1.5, ["metric"])


CYCLE = f"""
cy AS (SELECT p.grp, count(*) FILTER (pay_time >= p.s AND pay_time <= p.e) AS pays, count(*) FILTER (lock_time >= p.e AND lock_time < p.e + {N}) AS locks
  FROM p LEFT JOIN fo ON fo.grp = p.grp GROUP BY ALL)
"""


@query("cycle_counts", f"WITH {SQL_FO}, {CYCLE} SELECT grp, pays, locks FROM cy")
def cycle_counts(spark, sf):
    return co.cycle_counts(*fo(spark, sf, "grp", "pay_time", "lock_time"), N)


@query("cycle_corr", f"""WITH {SQL_FO}, {CYCLE}, k AS (SELECT pays, locks, rank() OVER (ORDER BY pays) + (count(*) OVER (PARTITION BY pays) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY locks) + (count(*) OVER (PARTITION BY locks) - 1) / 2.0 AS b FROM cy) SELECT {r('corr(pays, locks)')} AS pearson, {r('corr(a, b)')} AS spearman FROM k""")
def cycle_corr(spark, sf):
    return co.cycle_corr(co.cycle_counts(*fo(spark, sf, "grp", "pay_time", "lock_time"), N))


@query("period_metric_compare", f"""WITH {SQL_EV}, {SQL_DAILY}, m AS (SELECT date, unnest(['signup', 'purchase']) AS metric, unnest([signup, purchase]) AS v FROM dm),
x AS (SELECT p.grp AS period, metric, sum(v) AS t, avg(v) AS a, count(DISTINCT date) AS n FROM m JOIN p ON date >= p.e AND date <= p.e + 4 GROUP BY ALL)
SELECT x.period, x.metric, {r('x.t')} AS total, {r('x.a')} AS daily_mean, x.n AS days, {r('(x.a - b.a) / b.a * 100')} AS growth_vs_G0, {r('(x.a - c.a) / c.a * 100')} AS growth_vs_G1
FROM x LEFT JOIN x b ON b.metric = x.metric AND b.period = 'G0' LEFT JOIN x c ON c.metric = x.metric AND c.period = 'G1'""")
def period_metric_compare(spark, sf):
    return co.period_metric_compare(daily_metrics(spark, sf), event_periods(spark), ["signup", "purchase"], 5, ["G0", "G1"])


@query("period_slice", f"WITH {SQL_FO} SELECT period, grp, count(*) AS orders, count(lock_time) AS locks FROM ps GROUP BY ALL")
def period_slice(spark, sf):
    o, p = fo(spark, sf, "grp", "pay_time", "lock_time")
    return pr.period_slice(o, p).groupBy("period", "grp").agg(F.count("*").alias("orders"), F.count("lock_time").alias("locks"))


@query("period_slice_any", f"""WITH {SQL_FO} SELECT grp, count(*) AS orders FROM fo WHERE EXISTS (SELECT 1 FROM p WHERE pay_time >= p.s AND pay_time <= p.e) GROUP BY 1""")
def period_slice_any(spark, sf):
    return pr.any_period(*fo(spark, sf, "grp", "pay_time")).groupBy("grp").agg(F.count("*").alias("orders"))


@query("group_period", f"WITH {SQL_FO} SELECT order_id, grp, {d('s')} AS start_date, {d('e')} AS end_date FROM gp WHERE pay_time >= s AND pay_time < e + 1")
def group_period(spark, sf):
    o, p = fo(spark, sf, "order_id", "grp", "pay_time")
    shouting = o.withColumn("grp", F.concat(F.lit(" "), F.lower("grp"), F.lit("-")))
    return pr.presale(shouting, p, "whole_day").select("order_id", "grp", "start_date", "end_date")


@query("exclude_groups", f"WITH {SQL_FO} SELECT grp, count(*) AS orders FROM fo WHERE grp NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def exclude_groups(spark, sf):
    o, _ = fo(spark, sf, "grp")
    return pr.exclude_groups(o, ["building", "Machin-ery"]).groupBy("grp").agg(F.count("*").alias("orders"))


@query("lock_window_filter", f"WITH {SQL_FO} SELECT order_id, grp, {d('lock_time')} AS lock_date FROM gp WHERE lock_time >= e AND lock_time < e + {N}")
def lock_window_filter(spark, sf):
    o, p = fo(spark, sf, "order_id", "grp", "lock_time")
    return pr.lock_window_filter(o, p, N).select("order_id", "grp", F.to_date("lock_time").alias("lock_date"))


@query("interval_days", f"""WITH {SQL_EV} SELECT grp, CAST(sum({whole_days('pay_time', 'lock_time')}) AS BIGINT) AS whole_days, {r('sum((epoch_us(lock_time) - epoch_us(pay_time)) / 86400000000.0)')} AS fractional_days,
CAST(sum({whole_days('lock_time', 'pay_time')}) AS BIGINT) AS whole_days_back FROM ev GROUP BY 1""")
def interval_days_query(spark, sf):
    o, _ = ev(spark, sf)
    return o.groupBy("grp").agg(
        F.sum(interval_days("pay_time", "lock_time")).alias("whole_days"),
        F.sum(interval_days("pay_time", "lock_time", whole=False)).alias("fractional_days"),
        F.sum(interval_days("lock_time", "pay_time")).alias("whole_days_back"),
    )


@query("day_index", f"""WITH {SQL_EV} SELECT order_id, grp, CAST(pay_time AS DATE) - s + 1 AS day_from_start, CAST(lock_time AS DATE) - e AS day_from_end FROM gp WHERE lock_time IS NOT NULL""")
def day_index_query(spark, sf):
    from launchlens.functions.semantics import day_index, days_from_end

    j = pr.group_period(*ev(spark, sf)).where(F.col("lock_time").isNotNull())
    return j.select(
        "order_id", "grp", day_index("pay_time", "start_date").alias("day_from_start"), days_from_end("lock_time", "end_date").alias("day_from_end")
    )
