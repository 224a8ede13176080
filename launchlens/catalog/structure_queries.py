"""Queries over distribution shifts and A/B samples, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchlens.catalog.bindings import SQL_EV, SQL_FO, SQL_REG, event_periods, fact_events, fact_orders, order_periods, registry
from launchlens.catalog.registry import div, query, r, whole_days
from launchlens.functions.semantics import age_band
from launchlens.operators import structure as st
from launchlens.operators.filters import SampleSpec, sample_filter
from launchlens.operators.periods import period_slice

TARGET, REF = "HOUSEHOLD", "FURNITURE"
HISTORY = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]
REGIONS, CHANNELS = ["region", "city"], ["channel"]
DIMS = {"region": REGIONS, "channel": CHANNELS, "gender": ["gender"], "age": ["age_band"]}
COLS = ("order_id", "grp", "pay_time", "refund_time", "region", "city", "channel", "gender", "age")

AGE_STRUCT = "CASE WHEN age IS NULL THEN 'unknown' WHEN age < 25 THEN '<25' WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44' WHEN age < 55 THEN '45-54' ELSE '55+' END"
AGE_AB = "CASE WHEN age >= 0 AND age < 25 THEN '<25' WHEN age >= 25 AND age < 35 THEN '25-35' WHEN age >= 35 AND age < 45 THEN '35-45' WHEN age >= 45 AND age < 55 THEN '45-55' WHEN age >= 55 AND age < 100 THEN '55+' END"


def sliced(spark, sf):
    return period_slice(fact_orders(spark, sf, *COLS), order_periods(spark)).withColumn("age_band", age_band("age", "structure"))


def long_sql(src: str, dims, keep: str) -> str:
    names = ", ".join(f"'{x}'" for x in dims)
    vals = ", ".join(f"CAST({AGE_STRUCT if x == 'age_band' else x} AS VARCHAR)" for x in dims)
    return f"SELECT {keep}, unnest([{names}]) AS dimension, unnest([{vals}]) AS value FROM {src}"


ROUT = f"""target_n, {r('ts')} AS target_share, base_n, {r('bs')} AS base_share, {r(div('ts - bs', 'bs'))} AS change,
CASE WHEN bs = 0 THEN 'new' WHEN ts > bs THEN 'up' ELSE 'down' END AS direction"""


def flags(t: float, floor: float | None) -> str:
    if floor is None:
        return f"bs > 0 AND abs(ts - bs) / bs > {t}"
    return f"ts > {floor} AND (bs = 0 OR abs(ts - bs) / bs > {t})"


def shift_sql(dims, base, t, floor, check, label) -> str:
    b = ", ".join(f"'{x}'" for x in base)
    return f"""SELECT '{check}' AS "check", '{label}' AS baseline, dimension, value, {ROUT} FROM (
  SELECT dimension, value, CAST(coalesce(sum(n) FILTER (period = '{TARGET}'), 0) AS BIGINT) AS target_n, coalesce(sum(sh) FILTER (period = '{TARGET}'), 0) AS ts,
    CAST(coalesce(sum(n) FILTER (period <> '{TARGET}'), 0) AS BIGINT) AS base_n, coalesce(sum(sh) FILTER (period <> '{TARGET}'), 0) / {len(base)} AS bs
  FROM (SELECT period, dimension, value, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY period, dimension) AS sh
    FROM ({long_sql('ps', dims, 'period')}) WHERE value IS NOT NULL AND period IN ('{TARGET}', {b}) GROUP BY period, dimension, value) GROUP BY ALL) WHERE {flags(t, floor)}"""


def refund_sql(dims, t, floor, check) -> str:
    return f"""SELECT '{check}' AS "check", 'overall' AS baseline, dimension, value, {ROUT} FROM (
  SELECT dimension, value, tn AS target_n, bn AS base_n, tn / nullif(sum(tn) OVER w, 0) AS ts, bn / sum(bn) OVER w AS bs FROM (
    SELECT dimension, value, count(*) FILTER (rf) AS tn, count(*) AS bn FROM ({long_sql("(SELECT * FROM ps WHERE period = '" + TARGET + "')", dims, 'refund_time IS NOT NULL AS rf')})
    WHERE value IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY dimension)) WHERE {flags(t, floor)}"""


TARGET_ROWS = "(SELECT * FROM ps WHERE period = '" + TARGET + "')"


def dod_sql(dims, check, as_of: str = f"(SELECT max(CAST(pay_time AS DATE)) FROM {TARGET_ROWS})", src: str = TARGET_ROWS) -> str:
    return f"""SELECT '{check}' AS "check", 'previous_day' AS baseline, dimension, value, tn AS target_n, CAST(NULL AS DOUBLE) AS target_share, bn AS base_n, CAST(NULL AS DOUBLE) AS base_share,
  {r(div('tn - bn', 'bn'))} AS change, CASE WHEN bn = 0 THEN 'new' WHEN tn > bn THEN 'up' ELSE 'down' END AS direction FROM (
  SELECT dimension, value, count(*) FILTER (dy = {as_of}) AS tn, count(*) FILTER (dy = {as_of} - 1) AS bn
  FROM ({long_sql(f"(SELECT * FROM {src} WHERE refund_time IS NOT NULL)", dims, 'CAST(refund_time AS DATE) AS dy')}) WHERE value IS NOT NULL GROUP BY ALL)
  WHERE (bn > 0 AND tn >= 1 AND abs(tn - bn) / bn > 0.1) OR (bn = 0 AND tn >= 2)"""


@query("value_share", f"""WITH {SQL_FO} SELECT period, dimension, value, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY period, dimension)')} AS share
FROM ({long_sql('ps', ['region', 'channel', 'gender'], 'period')}) WHERE value IS NOT NULL GROUP BY period, dimension, value""")
def value_share(spark, sf):
    return st.value_share(sliced(spark, sf), ["region", "channel", "gender"], ["period"])


@query("shift_vs_history_region", f"WITH {SQL_FO} {shift_sql(REGIONS, HISTORY, 0.05, 0.01, 'region', 'history')}")
def shift_vs_history_region(spark, sf):
    return st.share_shift(sliced(spark, sf), TARGET, HISTORY, REGIONS, 0.05, check="region")


@query("shift_vs_history_channel", f"WITH {SQL_FO} {shift_sql(CHANNELS, HISTORY, 0.02, 0.01, 'channel', 'history')}")
def shift_vs_history_channel(spark, sf):
    return st.share_shift(sliced(spark, sf), TARGET, HISTORY, CHANNELS, 0.02, check="channel")


@query("shift_vs_history_demographic", f"WITH {SQL_FO} {shift_sql(['gender', 'age_band'], HISTORY, 0.02, None, 'demographic', 'history')}")
def shift_vs_history_demographic(spark, sf):
    return st.share_shift(sliced(spark, sf), TARGET, HISTORY, ["gender", "age_band"], 0.02, None, False, "demographic")


@query("shift_vs_group", f"WITH {SQL_FO} {shift_sql(REGIONS + CHANNELS, [REF], 0.15, 0.01, 'structure', 'reference')}")
def shift_vs_group(spark, sf):
    return st.share_shift(sliced(spark, sf), TARGET, [REF], REGIONS + CHANNELS, 0.15, baseline="reference")


@query("shift_refund", f"WITH {SQL_FO} {refund_sql(REGIONS + CHANNELS, 0.05, 0.01, 'refund_structure')}")
def shift_refund(spark, sf):
    own = sliced(spark, sf).where(F.col("period") == TARGET)
    return st.share_shift_refund(own, REGIONS + CHANNELS, 0.05)


DOD_DIMS = ["region", "city", "channel", "gender", "age_band"]
DOD_DAY = "DATE '1998-06-15'"


@query("refund_dod", f"WITH {SQL_FO} {dod_sql(DOD_DIMS, 'refund_day_over_day', DOD_DAY, 'fo')}")
def refund_dod(spark, sf):
    orders = fact_orders(spark, sf, *COLS).withColumn("age_band", age_band("age", "structure"))
    return st.refund_dod(orders, DOD_DIMS, "1998-06-15")


def _all_checks_sql() -> str:
    parts = []
    for name, cols in DIMS.items():
        floor = None if name in st.DEMOGRAPHIC else 0.01
        parts.append(shift_sql(cols, HISTORY, st.SHIFT_THRESHOLDS[name], floor, name, "history"))
        parts.append(shift_sql(cols, [REF], st.SHIFT_THRESHOLDS[name], floor, name, "reference"))
        parts.append(refund_sql(cols, st.REFUND_THRESHOLDS[name], floor, name))
        parts.append(dod_sql(cols, name))
    return " UNION ALL ".join(f"({x})" for x in parts)


@query("anomaly_report", f"WITH {SQL_FO} {_all_checks_sql()}")
def anomaly_report(spark, sf):
    return st.launch_checks(sliced(spark, sf), TARGET, HISTORY, REF, DIMS)


@query("anomaly_counts", f"""WITH {SQL_FO}, z AS ({_all_checks_sql()}) SELECT "check", baseline, direction, count(*) AS n FROM z GROUP BY ALL""")
def anomaly_counts(spark, sf):
    return st.anomaly_counts(st.launch_checks(sliced(spark, sf), TARGET, HISTORY, REF, DIMS))


# A: orders of 1996 refunded or not, region Asia..; B: orders of 1997 up to June.
A_SPEC = SampleSpec(pay=("1996-01-01", "1996-12-31"), exclude_refund=True)
B_SPEC = SampleSpec(pay=("1997-01-01", "1997-06-30"))
AB = """
sa AS (SELECT * FROM fo WHERE pay_time >= DATE '1996-01-01' AND pay_time <= DATE '1996-12-31' AND refund_time IS NULL),
sb AS (SELECT * FROM fo WHERE pay_time >= DATE '1997-01-01' AND pay_time <= DATE '1997-06-30'),
ab AS (SELECT 'A' AS sample, * FROM sa UNION ALL SELECT 'B' AS sample, * FROM sb)
"""
AB_COLS = ("order_id", "grp", "pay_time", "refund_time", "lock_time", "region", "city", "channel", "gender", "age", "buyer_id", "buyer_phone", "agent_name", "agent_id")


def samples(spark, sf, *cols):
    o = fact_orders(spark, sf, *cols)
    return sample_filter(o, A_SPEC), sample_filter(o, B_SPEC)


def ab_sql(dims, t, floor, check, where="TRUE") -> str:
    names = ", ".join(f"'{x}'" for x in dims)
    vals = ", ".join(f"CAST({AGE_AB if x == 'age_band' else x} AS VARCHAR)" for x in dims)
    share = "a_s > 0.01 AND " if floor is not None else ""
    sf = f"({share}b_s > 0 AND abs(a_s - b_s) / nullif(b_s, 0) > {t})"
    cf = "(CASE WHEN b_n > 0 THEN abs(a_n - b_n) / nullif(b_n, 0) > 0.5 ELSE a_n > 0 END)"
    return f"""SELECT '{check}' AS "check", dimension, value,
  CASE WHEN b_s = 0 THEN 'new' WHEN coalesce({sf}, false) AND {cf} THEN 'structure/count' WHEN coalesce({sf}, false) THEN 'structure' ELSE 'count' END AS kind,
  a_n, b_n, {r('a_s')} AS a_share, {r('b_s')} AS b_share, {r('a_s - b_s')} AS change, {r(div('a_n - b_n', 'b_n'))} AS relative_change FROM (
  SELECT *, a_n / sum(a_n) OVER (PARTITION BY dimension) AS a_s, b_n / sum(b_n) OVER (PARTITION BY dimension) AS b_s FROM (
    SELECT dimension, value, count(*) FILTER (sample = 'A') AS a_n, count(*) FILTER (sample = 'B') AS b_n
    FROM (SELECT sample, unnest([{names}]) AS dimension, unnest([{vals}]) AS value FROM ab WHERE {where}) WHERE value IS NOT NULL GROUP BY ALL))
  WHERE coalesce({sf}, false) OR {cf}"""


@query("ab_region", f"WITH {SQL_FO}, {AB} {ab_sql(REGIONS, 0.1, 0.01, 'region')}")
def ab_region(spark, sf):
    a, b = samples(spark, sf, "pay_time", "refund_time", "lock_time", "region", "city")
    return st.ab_shift(a, b, REGIONS, 0.1)


@query("ab_region_restricted", f"WITH {SQL_FO}, {AB} " + ab_sql(["city"], 0.1, 0.01, "region", "region IN ('ASIA', 'EUROPE')"))
def ab_region_restricted(spark, sf):
    a, b = samples(spark, sf, "pay_time", "refund_time", "lock_time", "region", "city")
    return st.ab_shift(a, b, REGIONS, 0.1, regions=["ASIA", "EUROPE"])


@query("ab_channel", f"WITH {SQL_FO}, {AB} {ab_sql(CHANNELS, 0.02, 0.01, 'channel')}")
def ab_channel(spark, sf):
    a, b = samples(spark, sf, "pay_time", "refund_time", "lock_time", "channel")
    return st.ab_shift(a, b, CHANNELS, 0.02, check="channel")


@query("ab_demographic", f"WITH {SQL_FO}, {AB} ({ab_sql(['gender'], 0.01, None, 'gender')}) UNION ALL ({ab_sql(['age_band'], 0.03, 0.01, 'age')})")
def ab_demographic(spark, sf):
    a, b = samples(spark, sf, "pay_time", "refund_time", "lock_time", "gender", "age")
    a, b = (x.withColumn("age_band", age_band("age", "ab")) for x in (a, b))
    gender = st.ab_shift(a, b, ["gender"], 0.01, floor=None, check="gender")
    return gender.unionByName(st.ab_shift(a, b, ["age_band"], 0.03, check="age"))


AB_ALL = " UNION ALL ".join(
    f"({ab_sql(cols, st.AB_THRESHOLDS[n], None if n == 'gender' else 0.01, n)})" for n, cols in DIMS.items()
)


@query("ab_report", f"WITH {SQL_FO}, {AB} {AB_ALL}")
def ab_report(spark, sf):
    a, b = samples(spark, sf, "pay_time", "refund_time", "lock_time", "region", "city", "channel", "gender", "age")
    a, b = (x.withColumn("age_band", age_band("age", "ab")) for x in (a, b))
    return st.ab_report(a, b, DIMS)


@query("ab_report_counts", f"""WITH {SQL_FO}, {AB}, z AS ({AB_ALL}) SELECT "check", kind, count(*) AS n FROM z GROUP BY ALL""")
def ab_report_counts(spark, sf):
    return st.counts_by_kind(ab_report(spark, sf))


@query("ab_agent", f"""WITH {SQL_FO}, {SQL_REG}, {AB},
m AS (SELECT ab.*, reg.agent_card IS NOT NULL AS ag FROM ab LEFT JOIN reg ON reg.agent_name = ab.agent_name AND reg.agent_code = ab.agent_id AND reg.agent_card = CAST(ab.buyer_id AS VARCHAR)),
b1 AS (SELECT sample, buyer_id, count(*) AS n FROM m WHERE buyer_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
b2 AS (SELECT sample, buyer_id, buyer_phone, count(*) AS n FROM m WHERE buyer_id IS NOT NULL AND buyer_phone IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
t AS (SELECT sample, count(*) AS t, count(DISTINCT buyer_id) AS u, count(*) FILTER (ag) AS a FROM m GROUP BY 1),
v AS (SELECT t.*, coalesce((SELECT sum(n) FROM b1 WHERE b1.sample = t.sample), 0) AS ro, (SELECT count(*) FROM b1 WHERE b1.sample = t.sample) AS rb,
  coalesce((SELECT sum(n) FROM b2 WHERE b2.sample = t.sample), 0) AS co, (SELECT count(*) FROM b2 WHERE b2.sample = t.sample) AS cb FROM t),
w AS (SELECT sample, unnest(['total_orders', 'unique_buyers', 'agent_orders', 'agent_ratio', 'repeat_orders', 'repeat_ratio', 'repeat_buyers', 'repeat_orders_combo', 'repeat_ratio_combo', 'repeat_buyers_combo']) AS metric,
  unnest([CAST(t AS DOUBLE), u, a, a / t, CAST(ro AS DOUBLE), CAST(ro AS DOUBLE) / t, rb, CAST(co AS DOUBLE), CAST(co AS DOUBLE) / t, cb]) AS x FROM v)
SELECT metric, {r("max(x) FILTER (sample = 'A')")} AS a, {r("max(x) FILTER (sample = 'B')")} AS b, {r("max(x) FILTER (sample = 'A') - max(x) FILTER (sample = 'B')")} AS diff FROM w GROUP BY 1""")
def ab_agent(spark, sf):
    a, b = samples(spark, sf, "order_id", "pay_time", "refund_time", "lock_time", "buyer_id", "buyer_phone", "agent_name", "agent_id")
    return st.ab_agent(a, b, registry(spark, sf))


AB_EV = {"pay_to_refund": ("pay_time", "refund_time"), "pay_to_assign": ("pay_time", "assign_time"), "pay_to_lock": ("pay_time", "lock_time")}


@query("ab_interval", f"""WITH {SQL_EV}, ab AS (SELECT 'A' AS sample, * FROM ev WHERE pay_time <= DATE '2024-01-12' AND pay_time >= DATE '2024-01-02' UNION ALL
  SELECT 'B' AS sample, * FROM ev WHERE pay_time <= DATE '2024-01-22' AND pay_time >= DATE '2024-01-12'),
x AS (SELECT sample, unnest(['pay_to_refund', 'pay_to_assign', 'pay_to_lock']) AS metric, unnest([{whole_days('pay_time', 'refund_time')}, {whole_days('pay_time', 'assign_time')}, {whole_days('pay_time', 'lock_time')}]) AS v FROM ab),
y AS (SELECT sample, metric, count(v) AS n, avg(v) AS m, median(v) AS md, coalesce(stddev_samp(v), 0) AS s FROM x WHERE v IS NOT NULL GROUP BY ALL)
SELECT a.metric, {r('a.n')} AS a_count, {r('b.n')} AS b_count, {r('a.m')} AS a_mean, {r('b.m')} AS b_mean, {r('a.md')} AS a_median, {r('b.md')} AS b_median, {r('a.s')} AS a_std, {r('b.s')} AS b_std,
{r('a.m - b.m')} AS diff_mean, {r('a.md - b.md')} AS diff_median FROM y a JOIN y b ON a.metric = b.metric WHERE a.sample = 'A' AND b.sample = 'B'""")
def ab_interval(spark, sf):
    o = fact_events(spark, sf)
    a = sample_filter(o, SampleSpec(pay=("2024-01-02", "2024-01-12")))
    b = sample_filter(o, SampleSpec(pay=("2024-01-12", "2024-01-22")))
    return st.ab_interval(a, b, AB_EV)
