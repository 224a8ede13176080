"""Queries over daily curves, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchlens.catalog.bindings import (
    EVENT_GROUPS, N_EVENTS, SQL_DAILY, SQL_EV, SQL_FO, daily_metrics, event_periods, fact_events, fact_orders, order_periods,
)
from launchlens.catalog.registry import d, div, query, r
from launchlens.operators import curves as cv

N = N_EVENTS
TARGET = "G4"

CURVE = """
dc0 AS (SELECT grp, s, e, CAST(pay_time AS DATE) AS dt, count(*) AS n FROM gp GROUP BY ALL),
dc AS (SELECT grp, dt, dt - s + 1 AS day, n, sum(n) OVER (PARTITION BY grp ORDER BY dt) AS cum,
  lag(n) OVER (PARTITION BY grp ORDER BY dt) AS prev FROM dc0 WHERE dt BETWEEN s AND e)
"""

DAYS = """
pd0 AS (SELECT period, s, CAST(pay_time AS DATE) AS dt, 1 AS o, 0 AS r FROM ps
  UNION ALL SELECT period, s, CAST(refund_time AS DATE), 0, 1 FROM ps WHERE refund_time IS NOT NULL),
pd1 AS (SELECT period, s, dt, sum(o) AS o, sum(r) AS r FROM pd0 GROUP BY ALL),
pd AS (SELECT period, dt, dt - s + 1 AS day, CAST(o AS BIGINT) AS orders, CAST(r AS BIGINT) AS refunds,
  CAST(sum(o) OVER w AS BIGINT) AS cum_orders, CAST(sum(r) OVER w AS BIGINT) AS cum_refunds
  FROM pd1 WINDOW w AS (PARTITION BY period ORDER BY dt)),
od AS (SELECT * FROM pd WHERE orders > 0)
"""


def ev(spark, sf, *want):
    return fact_events(spark, sf, *want), event_periods(spark)


def days(spark, sf):
    return cv.period_daily(*ev(spark, sf))


@query("daily_curve", f"""WITH {SQL_EV}, {CURVE}
SELECT grp, {d('dt')} AS date, day, n AS daily_orders, CAST(cum AS BIGINT) AS cumulative_orders, {r(div('n - prev', 'prev') + ' * 100')} AS change_pct FROM dc""")
def daily_curve(spark, sf):
    return cv.daily_curve(*ev(spark, sf, "grp", "pay_time"))


@query("dod_anomaly", f"""WITH {SQL_EV}, {DAYS}, x AS (SELECT *, lag(orders) OVER (PARTITION BY period ORDER BY dt) AS prev FROM od)
SELECT period, {d('dt')} AS date, orders, prev AS prev_orders, {r('(orders - prev) / prev')} AS change FROM x
WHERE period = '{TARGET}' AND abs((orders - prev) / prev) > 0.25""")
def dod_anomaly(spark, sf):
    return cv.dod_anomaly(days(spark, sf), TARGET, 0.25)


@query("aligned_anomaly", f"""WITH {SQL_EV}, {DAYS}
SELECT b.period AS base, {d('t.dt')} AS date, t.day, t.orders AS target_orders, b.orders AS base_orders, {r('(t.orders - b.orders) / b.orders')} AS change
FROM od t JOIN od b ON b.day = t.day AND b.period <> t.period WHERE t.period = '{TARGET}' AND abs((t.orders - b.orders) / b.orders) > 0.3""")
def aligned_anomaly(spark, sf):
    return cv.aligned_anomaly(days(spark, sf), TARGET, 0.3)


@query("aligned_cum_anomaly", f"""WITH {SQL_EV}, {DAYS}, x AS (
  SELECT t.dt, t.day, t.cum_orders AS tc, b.period AS base,
    (SELECT max(y.cum_orders) FROM od y WHERE y.period = b.period AND y.day <= t.day) AS bc
  FROM od t, (SELECT DISTINCT period FROM od) b WHERE t.period = '{TARGET}' AND b.period <> '{TARGET}')
SELECT base, {d('dt')} AS date, day, tc AS target_cum, bc AS base_cum, {r('(tc - bc) / bc')} AS change FROM x WHERE bc > 0 AND abs((tc - bc) / bc) > 0.05""")
def aligned_cum_anomaly(spark, sf):
    return cv.aligned_cum_anomaly(days(spark, sf), TARGET, 0.05)


@query("latest_day_compare", f"""WITH {SQL_EV}, {DAYS}
SELECT period = '{TARGET}' AS is_target, period, {d('dt')} AS date, day, orders, cum_orders FROM od
WHERE day = (SELECT max(day) FROM od WHERE period = '{TARGET}')""")
def latest_day_compare(spark, sf):
    return cv.latest_day_compare(days(spark, sf), TARGET)


@query("latest_refund_compare", f"""WITH {SQL_EV}, {DAYS}
SELECT period = 'G0' AS is_target, period, {d('dt')} AS date, day, refunds, cum_refunds FROM pd
WHERE refunds > 0 AND day = (SELECT max(day) FROM pd WHERE period = 'G0' AND refunds > 0)""")
def latest_refund_compare(spark, sf):
    return cv.latest_refund_compare(days(spark, sf), "G0")


@query("previous_day_compare", f"""WITH {SQL_EV}, {DAYS}
SELECT period = '{TARGET}' AS is_target, period, {d('dt')} AS date, day, orders, refunds, cum_orders, cum_refunds FROM od
WHERE day = (SELECT day FROM od WHERE period = '{TARGET}' ORDER BY day DESC LIMIT 1 OFFSET 1)""")
def previous_day_compare(spark, sf):
    return cv.nth_last_compare(days(spark, sf), TARGET, 2)


RATES = """
cr AS (SELECT period, dt, day, cum_orders, coalesce(last_value(CASE WHEN refunds > 0 THEN cum_refunds END IGNORE NULLS)
  OVER (PARTITION BY period ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS cum_refunds FROM od),
rt AS (SELECT *, cum_refunds * 100.0 / cum_orders AS rate FROM cr WHERE day >= 1)
"""


@query("cum_refund_rate", f"""WITH {SQL_EV}, {DAYS}, {RATES}
SELECT period, {d('dt')} AS date, day, cum_orders, cum_refunds, {r('cum_refunds / cum_orders * 100')} AS refund_rate_pct FROM rt""")
def cum_refund_rate(spark, sf):
    return cv.cum_refund_rate(days(spark, sf))


@query("cum_refund_rate_dense", f"""WITH {SQL_EV}, {DAYS}
SELECT period, {d('dt')} AS date, day, cum_orders, cum_refunds, {r('coalesce(' + div('cum_refunds', 'cum_orders') + ', 0) * 100')} AS refund_rate_pct FROM pd WHERE day >= 1""")
def cum_refund_rate_dense(spark, sf):
    return cv.cum_refund_rate(days(spark, sf), dense_days=True)


@query("refund_progress", f"""WITH {SQL_EV}, {DAYS}, {RATES},
m AS (SELECT p.grp AS period, e - s AS total, pct, floor((e - s) * pct / 100) AS target_day FROM p, generate_series(0, 100, 10) AS g(pct)),
x AS (SELECT m.period, pct, target_day, total, coalesce(arg_max(rate, day) FILTER (day - 1 <= target_day), arg_min(rate, day)) AS rate, max(day - 1) AS reached
  FROM m JOIN rt ON rt.period = m.period GROUP BY ALL)
SELECT period, pct, {r('rate')} AS refund_rate_pct FROM x WHERE period <> '{TARGET}' OR pct <= floor(reached / total * 100)""")
def refund_progress(spark, sf):
    return cv.refund_progress(cv.cum_refund_rate(days(spark, sf)), event_periods(spark), TARGET)


@query("refund_rate_jump", f"""WITH {SQL_EV}, {DAYS}, {RATES},
atd AS (SELECT day FROM od WHERE period = '{TARGET}' ORDER BY day DESC LIMIT 1 OFFSET 1),
cur AS (SELECT arg_max(rate, day) AS c FROM rt WHERE period = '{TARGET}'),
prv AS (SELECT cum_refunds / cum_orders * 100 AS q FROM od WHERE period = '{TARGET}' AND day = (SELECT day FROM atd)),
h AS (SELECT o.period, o.cum_refunds / o.cum_orders * 100 AS n,
  (SELECT arg_max(y.cum_refunds / nullif(y.cum_orders, 0), y.day) * 100 FROM pd y WHERE y.period = o.period AND y.day <= o.day - 1) AS b
  FROM od o WHERE o.period <> '{TARGET}' AND o.day = (SELECT day FROM atd)),
g AS (SELECT count(*) AS launches, avg(abs((n - b) / b * 100)) AS m FROM h WHERE b > 0),
z AS (SELECT c, q, coalesce((c - q) / nullif(q, 0), 0) * 100 AS ch, launches, m, greatest(20.0, coalesce(m * 1.5, 20.0)) AS t FROM cur, prv, g)
SELECT {r('c')} AS current_rate_pct, {r('q')} AS previous_rate_pct, {r('ch')} AS change_pct, launches, {r('m')} AS mean_history_change_pct,
  {r('t')} AS threshold_pct, abs(ch) > t AS is_anomaly FROM z""")
def refund_rate_jump(spark, sf):
    return cv.refund_rate_jump(days(spark, sf), TARGET)


RATE_CLASS = "CASE WHEN rate = 0 THEN 'none' WHEN rate < 10 THEN 'low' WHEN rate < 20 THEN 'mid' ELSE 'high' END"


@query("cohort_refund", f"""WITH {SQL_EV}, x AS (
  SELECT grp, CAST(pay_time AS DATE) - s AS day_offset, count(*) AS orders, count(*) FILTER (refund_time <= s + 8) AS refunds,
    count(*) FILTER (refund_time <= s + 8) / count(*) * 100 AS rate FROM gp GROUP BY ALL)
SELECT grp, day_offset, orders, refunds, {r('rate')} AS refund_rate_pct, {RATE_CLASS} AS rate_class FROM x WHERE day_offset BETWEEN 0 AND 8""")
def cohort_refund(spark, sf):
    return cv.cohort_refund(*ev(spark, sf, "grp", "pay_time", "refund_time"), 8)


@query("cohort_refund_aligned", f"""WITH {SQL_EV}, ob AS (SELECT max(CAST(pay_time AS DATE) - s) AS k FROM ps WHERE period = 'G1')
SELECT period, CAST(pay_time AS DATE) - s AS day_offset, count(*) AS orders, count(*) FILTER (refund_time <= s + CAST(k AS INTEGER)) AS refunds,
  {r('count(*) FILTER (refund_time <= s + CAST(k AS INTEGER)) / count(*) * 100')} AS refund_rate_pct FROM ps, ob GROUP BY 1, 2""")
def cohort_refund_aligned(spark, sf):
    return cv.cohort_refund_aligned(*ev(spark, sf), "G1")


REFUNDS = """
rc0 AS (SELECT grp, s, CAST(refund_time AS DATE) AS dt, count(*) AS n FROM gp WHERE refund_time IS NOT NULL GROUP BY ALL),
rc AS (SELECT grp, dt, dt - s + 1 AS day, n, sum(n) OVER (PARTITION BY grp ORDER BY dt) AS cum FROM rc0 WHERE dt - s + 1 BETWEEN 1 AND 10)
"""


@query("refund_curve", f"""WITH {SQL_EV}, {REFUNDS}
SELECT grp, {d('dt')} AS date, day, n AS daily_refunds, CAST(cum AS BIGINT) AS cumulative_refunds FROM rc""")
def refund_curve(spark, sf):
    return cv.refund_curve(*ev(spark, sf, "grp", "pay_time", "refund_time"), 10)


@query("refund_rate_curve", f"""WITH {SQL_EV}, {CURVE}, {REFUNDS},
g AS (SELECT grp, day FROM (SELECT DISTINCT grp FROM dc), generate_series(1, 10) AS t(day)),
x AS (SELECT g.grp, g.day, coalesce(last_value(dc.cum IGNORE NULLS) OVER w, 0) AS o, coalesce(last_value(rc.cum IGNORE NULLS) OVER w, 0) AS rf
  FROM g LEFT JOIN dc ON dc.grp = g.grp AND dc.day = g.day LEFT JOIN rc ON rc.grp = g.grp AND rc.day = g.day
  WINDOW w AS (PARTITION BY g.grp ORDER BY g.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT grp, day, CAST(o AS BIGINT) AS cumulative_orders, CAST(rf AS BIGINT) AS cumulative_refunds, {r('coalesce(' + div('rf', 'o') + ', 0) * 100')} AS refund_rate_pct FROM x""")
def refund_rate_curve(spark, sf):
    return cv.refund_rate_curve(*ev(spark, sf, "grp", "pay_time", "refund_time"), 10)


CONVERSION = f"""
cb AS (SELECT grp, CAST(pay_time AS DATE) - s + 1 AS day, count(*) FILTER (lock_time < e + {N}) AS locks, count(*) AS total
  FROM gp WHERE CAST(pay_time AS DATE) BETWEEN s AND e GROUP BY ALL)
"""


@query("conversion_by_day", f"""WITH {SQL_EV}, {CONVERSION} SELECT grp, day, locks, total, {r('locks / total * 100')} AS conversion_pct FROM cb""")
def conversion_by_day(spark, sf):
    return cv.conversion_by_day(*ev(spark, sf), N)


def _wide_sql() -> str:
    parts = []
    for v, e in (("orders", "total"), ("cum_orders", "cum"), ("locks", "locks")):
        parts += [f"max(CASE WHEN grp = '{g}' THEN {e} END) AS {g}_{v}" for g in EVENT_GROUPS]
    parts += [f"max(CASE WHEN grp = '{g}' THEN {r('locks / total * 100')} END) AS {g}_conversion_pct" for g in EVENT_GROUPS]
    return ", ".join(parts)


@query("daily_change_table", f"""WITH {SQL_EV}, {CONVERSION}, x AS (SELECT *, CAST(sum(total) OVER (PARTITION BY grp ORDER BY day) AS BIGINT) AS cum FROM cb)
SELECT day, {_wide_sql()} FROM x GROUP BY day""")
def daily_change_table(spark, sf):
    return cv.daily_change_table(*ev(spark, sf), EVENT_GROUPS, N)


LOCKS = """
lc0 AS (SELECT grp, CAST(lock_time AS DATE) AS dt, CAST(lock_time AS DATE) - e AS day, count(*) AS n,
  count(*) FILTER (CAST(pay_time AS DATE) <= e) AS rl, count(*) FILTER (CAST(pay_time AS DATE) > e) AS pl FROM gp WHERE lock_time IS NOT NULL GROUP BY ALL),
lc AS (SELECT *, CAST(sum(n) OVER (PARTITION BY grp ORDER BY day) AS BIGINT) AS cum, lag(n) OVER (PARTITION BY grp ORDER BY day) AS prev FROM lc0 WHERE day BETWEEN 0 AND 12)
"""


@query("lock_curve", f"WITH {SQL_EV}, {LOCKS} SELECT grp, {d('dt')} AS date, day, n AS daily_locks, cum AS cumulative_locks FROM lc")
def lock_curve(spark, sf):
    return cv.lock_curve(*ev(spark, sf, "grp", "pay_time", "lock_time"), 12)


@query("lock_change", f"""WITH {SQL_EV}, {LOCKS} SELECT grp, {d('dt')} AS date, day, n AS daily_locks, cum AS cumulative_locks, CAST(prev AS DOUBLE) AS prev_daily_locks,
{r('coalesce(' + div('n - prev', 'prev') + ' * 100, 0)')} AS change_pct FROM lc""")
def lock_change(spark, sf):
    return cv.lock_change(cv.lock_curve(*ev(spark, sf, "grp", "pay_time", "lock_time"), 12))


@query("lock_conversion_curve", f"""WITH {SQL_EV},
t AS (SELECT grp, count(*) FILTER (pay_time >= s AND pay_time <= e) AS total FROM gp GROUP BY 1),
x AS (SELECT grp, CAST(lock_time AS DATE) AS dt, CAST(lock_time AS DATE) - e AS day, count(*) AS n FROM gp WHERE lock_time IS NOT NULL AND pay_time <= e GROUP BY ALL),
y AS (SELECT *, CAST(sum(n) OVER (PARTITION BY grp ORDER BY dt) AS BIGINT) AS cum FROM x)
SELECT y.grp, {d('dt')} AS date, day, n AS daily_locks, cum AS cumulative_locks, {r('coalesce(' + div('cum', 'total') + ', 0) * 100')} AS conversion_pct
FROM y JOIN t ON t.grp = y.grp WHERE day BETWEEN 0 AND 12""")
def lock_conversion_curve(spark, sf):
    return cv.lock_conversion_curve(*ev(spark, sf, "grp", "pay_time", "lock_time"), 12)


@query("lock_performance", f"""WITH {SQL_EV}, {LOCKS},
g AS (SELECT grp, day FROM (SELECT DISTINCT grp FROM gp), generate_series(0, 12) AS t(day))
SELECT g.grp, g.day, coalesce(n, 0) AS daily_locks, coalesce(rl, 0) AS retained_locks, coalesce(pl, 0) AS post_launch_locks,
CAST(sum(coalesce(n, 0)) OVER (PARTITION BY g.grp ORDER BY g.day) AS BIGINT) AS cumulative_locks FROM g LEFT JOIN lc ON lc.grp = g.grp AND lc.day = g.day""")
def lock_performance(spark, sf):
    return cv.lock_performance(*ev(spark, sf, "grp", "pay_time", "lock_time"), 12)


def _lock_wide_sql() -> str:
    return ", ".join(
        f"max(CASE WHEN grp = '{g}' THEN {c} END) AS {g}_{v}" for v, c in (("daily_locks", "n"), ("cumulative_locks", "cum")) for g in EVENT_GROUPS
    )


@query("lock_performance_wide", f"""WITH {SQL_EV}, {LOCKS},
g AS (SELECT grp, day FROM (SELECT DISTINCT grp FROM gp), generate_series(0, 12) AS t(day)),
x AS (SELECT g.grp, g.day, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY g.grp ORDER BY g.day) AS BIGINT) AS cum
  FROM g LEFT JOIN lc ON lc.grp = g.grp AND lc.day = g.day)
SELECT day, {_lock_wide_sql()} FROM x GROUP BY day""")
def lock_performance_wide(spark, sf):
    return cv.wide(cv.lock_performance(*ev(spark, sf, "grp", "pay_time", "lock_time"), 12), "day", EVENT_GROUPS, ["daily_locks", "cumulative_locks"])


@query("post_launch_locks", f"""WITH {SQL_EV}, k AS (SELECT DATE '2024-01-24' - e - 1 AS n FROM p WHERE grp = '{TARGET}')
SELECT period, k.n AS n_days, {d('e + CAST(k.n AS INTEGER)')} AS lock_date,
  count(*) FILTER (CAST(lock_time AS DATE) = e + CAST(k.n AS INTEGER)) AS locks_on_day,
  count(*) FILTER (CAST(lock_time AS DATE) = e + CAST(k.n AS INTEGER) AND pay_time < e) AS retained_on_day,
  count(*) FILTER (CAST(lock_time AS DATE) BETWEEN e AND e + CAST(k.n AS INTEGER)) AS cum_locks,
  count(*) FILTER (CAST(lock_time AS DATE) BETWEEN e AND e + CAST(k.n AS INTEGER) AND pay_time < e) AS cum_retained
FROM ps, k GROUP BY ALL""")
def post_launch_locks(spark, sf):
    return cv.post_launch_locks(*ev(spark, sf), TARGET, "2024-01-24")


DELIVERY = """
dl AS (SELECT grp, CAST(invoice_time AS DATE) AS dt, count(order_id) AS n, avg(invoice_price) AS pr FROM fo
  WHERE invoice_time >= DATE '1997-01-01' AND invoice_time <= DATE '1998-12-31' GROUP BY ALL)
"""


def _delivery(spark, sf):
    fo = fact_orders(spark, sf, "order_id", "grp", "invoice_time", "invoice_price")
    return cv.delivery_curve(fo, "1997-01-01", "1998-12-31")


@query("delivery_curve", f"""WITH {SQL_FO}, {DELIVERY} SELECT grp, {d('dt')} AS date, n AS deliveries, {r('pr')} AS mean_price,
{r('avg(n) OVER w')} AS deliveries_ma7, {r('avg(pr) OVER w')} AS mean_price_ma7 FROM dl WINDOW w AS (PARTITION BY grp ORDER BY dt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def delivery_curve(spark, sf):
    return _delivery(spark, sf)


@query("delivery_summary", f"""WITH {SQL_FO}, {DELIVERY} SELECT CAST(sum(n) AS BIGINT) AS deliveries, {r('avg(pr)')} AS mean_of_daily_prices,
{d('min(dt)')} AS first_day, {d('max(dt)')} AS last_day, count(*) AS points FROM dl""")
def delivery_summary(spark, sf):
    return cv.delivery_summary(_delivery(spark, sf))


@query("metric_ma7", f"""WITH {SQL_DAILY} SELECT {d('date')} AS date, purchase, signup,
{r('avg(purchase) OVER w')} AS purchase_ma7, {r('avg(signup) OVER w')} AS signup_ma7 FROM dm WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def metric_ma7(spark, sf):
    return cv.moving_avg(daily_metrics(spark, sf).select("date", "purchase", "signup"), ["purchase", "signup"], 7)


PAIRS = """
dp AS (SELECT p.grp, CAST(t.g AS DATE) AS dt,
  (SELECT count(*) FROM gp WHERE gp.grp = p.grp AND CAST(pay_time AS DATE) = CAST(t.g AS DATE) AND pay_time >= gp.s AND pay_time <= gp.e) AS pays,
  (SELECT count(*) FROM gp WHERE gp.grp = p.grp AND CAST(lock_time AS DATE) = CAST(t.g AS DATE) AND lock_time >= gp.e AND lock_time < gp.e + 8) AS locks
  FROM p, generate_series(DATE '2024-01-01', DATE '2024-02-28', INTERVAL 1 DAY) AS t(g) WHERE t.g >= p.s AND t.g <= p.e + 7)
"""


def pair_series(spark, sf):
    return cv.daily_pair_series(*ev(spark, sf), 8)


@query("daily_pair_series", f"WITH {SQL_EV}, {PAIRS} SELECT grp, {d('dt')} AS date, pays, locks FROM dp")
def daily_pair_series(spark, sf):
    return pair_series(spark, sf)


CORRS = """
cc AS (SELECT a.grp, k.lag, CASE WHEN count(*) >= 3 AND stddev_pop(a.pays) > 0 AND stddev_pop(b.locks) > 0 THEN corr(a.pays, b.locks) END AS c
  FROM dp a, generate_series(0, 14) AS k(lag), dp b WHERE b.grp = a.grp AND b.dt = a.dt + CAST(k.lag AS INTEGER) GROUP BY ALL)
"""


@query("cross_corr", f"WITH {SQL_EV}, {PAIRS}, {CORRS} SELECT grp, lag, {r('c')} AS corr FROM cc")
def cross_corr(spark, sf):
    return cv.cross_corr(pair_series(spark, sf), 14)


@query("peak_lag", f"WITH {SQL_EV}, {PAIRS}, {CORRS} SELECT grp, lag, {r('c')} AS corr FROM cc WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(c, 9) DESC, lag) = 1")
def peak_lag(spark, sf):
    return cv.peak_lag(cv.cross_corr(pair_series(spark, sf), 14))


@query("step_interp", f"""WITH {SQL_EV}, {CONVERSION}, pt AS (SELECT grp, day AS x, locks / total * 100 AS y FROM cb),
gr AS (SELECT grp, k / 2.0 AS x FROM p, generate_series(0, 26) AS t(k)),
z AS (SELECT gr.grp, gr.x,
  (SELECT arg_max(y, pt.x) FROM pt WHERE pt.grp = gr.grp AND pt.x <= gr.x) AS y0, (SELECT max(pt.x) FROM pt WHERE pt.grp = gr.grp AND pt.x <= gr.x) AS x0,
  (SELECT arg_min(y, pt.x) FROM pt WHERE pt.grp = gr.grp AND pt.x >= gr.x) AS y1, (SELECT min(pt.x) FROM pt WHERE pt.grp = gr.grp AND pt.x >= gr.x) AS x1 FROM gr)
SELECT grp, {r('x')} AS day, {r('CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (y1 - y0) / (x1 - x0) * (x - x0) END')} AS rate FROM z""")
def step_interp(spark, sf):
    points = cv.conversion_by_day(*ev(spark, sf), N).select("grp", "day", F.col("conversion_pct").alias("rate"))
    grid = event_periods(spark).select("grp", F.explode(F.sequence(F.lit(0), F.lit(26))).alias("k")).select("grp", (F.col("k") / 2.0).alias("day"))
    return cv.interp_grid(points, grid)
