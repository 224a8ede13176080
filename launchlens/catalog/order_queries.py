"""Queries over filters, breakdowns, buyers, agents, stores and profiles, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchlens.catalog.bindings import (
    N_ORDERS, ORDER_GROUPS, SQL_EV, SQL_FO, SQL_REG, TOKENS, event_periods, fact_events, fact_orders, order_periods,
    product_classes, product_prices, registry, table,
)
from launchlens.catalog.registry import d, div, i, query, r, ts
from launchlens.functions import rules
from launchlens.functions.semantics import age_band
from launchlens.operators import breakdowns as bd
from launchlens.operators import buyers as by
from launchlens.operators import filters as fl
from launchlens.operators import profile as pf
from launchlens.operators import stores as so
from launchlens.plans.skew import first_row, last_row

N = N_ORDERS
GROUPS = ["AUTOMOBILE", "BUILDING", "FURNITURE"]
BASE = ("order_id", "grp", "pay_time", "refund_time", "lock_time", "invoice_time", "region", "city", "buyer_id", "product")


def fo(spark, sf, *cols):
    return fact_orders(spark, sf, *cols)


def isin(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


# ---- filters and derived columns

SPEC = fl.SampleSpec(
    pay=("1996-03-01", "1998-09-30"), lock=("1996-06-01", "1999-12-31"), categories=("range_extender",), regions=("ASIA", "EUROPE", "AFRICA"),
    groups=tuple(GROUPS), attr_classes=("STANDARD", "PROMO"), exclude_refund=True, repeat_only=True, category_tokens=TOKENS,
)
ATTR = "atr AS (SELECT p_name AS product, arg_min(p_type, p_partkey) AS attr FROM part GROUP BY 1 HAVING arg_min(p_type, p_partkey) <> 'ECONOMY')"


@query("sample_filter", f"""WITH {SQL_FO}, {ATTR}, rb AS (SELECT buyer_id FROM fo WHERE buyer_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1 AND min(invoice_time) < TIMESTAMP '1996-06-01')
SELECT order_id, grp, region, product FROM fo WHERE pay_time BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1998-09-30' AND lock_time BETWEEN TIMESTAMP '1996-06-01' AND TIMESTAMP '1999-12-31'
AND (contains(product, 'ring') OR contains(product, 'widget')) AND region IN ('ASIA', 'EUROPE', 'AFRICA') AND grp IN {isin(GROUPS)} AND refund_time IS NULL
AND product IN (SELECT product FROM atr WHERE attr IN ('STANDARD', 'PROMO')) AND buyer_id IN (SELECT buyer_id FROM rb)""")
def sample_filter(spark, sf):
    out = fl.sample_filter(fo(spark, sf, *BASE), SPEC, product_classes(spark, sf))
    return out.select("order_id", "grp", "region", "product")


@query("sample_filter_exclude_repeat", f"""WITH {SQL_FO}, rb AS (SELECT buyer_id FROM fo WHERE buyer_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1 AND min(invoice_time) < TIMESTAMP '1996-01-01')
SELECT order_id, grp FROM fo WHERE pay_time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' AND buyer_id NOT IN (SELECT buyer_id FROM rb)""")
def sample_filter_exclude_repeat(spark, sf):
    spec = fl.SampleSpec(pay=("1996-01-01", "1996-12-31"), exclude_repeat=True)
    return fl.sample_filter(fo(spark, sf, "order_id", "grp", "pay_time", "refund_time", "lock_time", "invoice_time", "buyer_id"), spec).select("order_id", "grp")


@query("spot_check", f"""WITH {SQL_FO}, x AS (SELECT count(*) FILTER (grp = 'BUILDING') AS a, count(*) FILTER (grp = 'BUILDING' AND CAST(pay_time AS DATE) >= DATE '1997-01-01') AS b,
count(*) FILTER (grp = 'BUILDING' AND CAST(pay_time AS DATE) >= DATE '1997-01-01' AND lock_time IS NOT NULL) AS c,
count(*) FILTER (grp = 'BUILDING' AND CAST(pay_time AS DATE) >= DATE '1997-01-01' AND lock_time < DATE '1998-06-30') AS e FROM fo)
SELECT unnest([1, 2, 3, 4])::BIGINT AS step, unnest(['group', 'paid', 'locked', 'before_cutoff']) AS condition, unnest([a, b, c, e]) AS orders FROM x""")
def spot_check(spark, sf):
    steps = [
        ("group", F.col("grp") == "BUILDING"),
        ("paid", F.to_date("pay_time") >= F.lit("1997-01-01").cast("date")),
        ("locked", F.col("lock_time").isNotNull()),
        ("before_cutoff", F.to_date("lock_time") < F.lit("1998-06-30").cast("date")),
    ]
    return fl.filter_funnel(fo(spark, sf, "grp", "pay_time", "lock_time"), steps)


CATEGORY = "CASE WHEN product IS NULL THEN 'unknown' WHEN contains(product, 'ring') OR contains(product, 'widget') THEN 'range_extender' ELSE 'battery' END"


@query("product_category", f"WITH {SQL_FO} SELECT {CATEGORY} AS category, count(*) AS orders FROM fo GROUP BY 1")
def product_category(spark, sf):
    c = rules.product_category("product", TOKENS).alias("category")
    return fo(spark, sf, "product").groupBy(c).agg(F.count("*").alias("orders"))


@query("attr_assign", f"WITH {SQL_FO}, {ATTR} SELECT coalesce(attr, 'unknown') AS attr, count(*) AS orders FROM fo LEFT JOIN atr ON atr.product = trim(fo.product) GROUP BY 1")
def attr_assign(spark, sf):
    return fl.attr_assign(fo(spark, sf, "product"), product_classes(spark, sf)).groupBy("attr").agg(F.count("*").alias("orders"))


PRICES = "pr AS (SELECT p_name AS product, CASE WHEN contains(p_name, 'blue') THEN 0 ELSE CAST(floor(min(p_retailprice)) AS BIGINT) END AS price FROM part GROUP BY 1)"


@query("price_lookup", f"WITH {SQL_FO}, {PRICES} SELECT fo.product, {r('nullif(price, 0)')} AS list_price, count(*) AS orders FROM fo LEFT JOIN pr ON pr.product = fo.product GROUP BY ALL")
def price_lookup(spark, sf):
    o = fl.price_lookup(fo(spark, sf, "product"), product_prices(spark, sf))
    return o.groupBy("product", F.col("list_price").cast("double").alias("list_price")).agg(F.count("*").alias("orders"))


def _band(edges, labels, closed):
    lo, hi = (">=", "<") if closed == "left" else (">", "<=")
    parts = [f"WHEN {'TRUE' if a is None else f'age {lo} {a}'} AND {'TRUE' if b is None else f'age {hi} {b}'} THEN '{x}'" for a, b, x in zip(edges[:-1], edges[1:], labels)]
    return "CASE " + " ".join(parts) + " END"


B1, B2 = _band([None, 25, 35, 45, 55, None], ["<25", "25-34", "35-44", "45-54", "55+"], "left"), _band([0, 25, 35, 45, 55, 100], ["<25", "25-35", "35-45", "45-55", "55+"], "left")
B3, B4 = _band([0, 25, 35, 45, 55, 100], ["<25", "25-35", "35-45", "45-55", "55+"], "right"), _band([None, 25, 30, 35, 40, 45, 50, 55, None], ["<25", "25-29", "30-34", "35-39", "40-44", "45-49", "50-54", "55+"], "left")


@query("age_band", f"WITH {SQL_FO} SELECT {B1} AS structure, {B2} AS ab, {B3} AS segments, {B4} AS lock, count(*) AS orders FROM fo GROUP BY ALL")
def age_bands(spark, sf):
    bands = [age_band("age", v).alias(v) for v in ("structure", "ab", "segments", "lock")]
    return fo(spark, sf, "age").groupBy(*bands).agg(F.count("*").alias("orders"))


@query("gender_norm", f"WITH {SQL_FO} SELECT CASE WHEN lower(trim(gender)) = 'f' THEN 'female' WHEN lower(trim(gender)) IN ('p') THEN 'male' ELSE 'unknown' END AS gender, count(*) AS orders FROM fo GROUP BY 1")
def gender_norm(spark, sf):
    words = {"male": ("P", "male"), "female": ("F", "female")}
    return fo(spark, sf, "gender").groupBy(rules.normalize_enum("gender", words).alias("gender")).agg(F.count("*").alias("orders"))


REGION_RULES = (("virtual", ("AMERICA", "AFRICA")), ("fac", ("A", "MID")))


@query("region_type", f"""WITH {SQL_FO} SELECT region, CASE WHEN contains(region, 'AMERICA') OR contains(region, 'AFRICA') THEN 'virtual' WHEN contains(region, 'A') OR contains(region, 'MID') THEN 'fac' ELSE 'traditional' END AS region_type,
count(*) AS orders FROM fo GROUP BY ALL""")
def region_type(spark, sf):
    named = F.col("region_name")
    return (
        fo(spark, sf, "region").select(rules.region_norm("region").alias("region_name"))
        .groupBy(named.alias("region"), rules.region_type("region_name", REGION_RULES).alias("region_type")).agg(F.count("*").alias("orders"))
    )


@query("deposit_map", f"WITH {SQL_FO} SELECT grp, {r('CASE WHEN contains(grp, $$BUILD$$) THEN 5000 WHEN contains(grp, $$IN$$) THEN 2000 END')} AS deposit, count(*) AS orders FROM fo GROUP BY ALL")
def deposit_map(spark, sf):
    rule = (("BUILD", 5000.0), ("IN", 2000.0))
    return fo(spark, sf, "grp").groupBy("grp", rules.map_contains("grp", rule).alias("deposit")).agg(F.count("*").alias("orders"))


_DIGITS = " + ".join(f"(ascii(substring(id_no, {k + 1}, 1)) - 48) * {w}" for k, w in enumerate(rules.ID_WEIGHTS))
ID_OK = f"(regexp_full_match(id_no, '[0-9]{{17}}[0-9X]') AND substring(id_no, 18, 1) = substring('10X98765432', CAST(({_DIGITS}) % 11 + 1 AS BIGINT), 1))"


@query("id_valid", f"WITH {SQL_FO} SELECT grp, count(*) AS orders, count(*) FILTER ({ID_OK}) AS valid, CAST(0 AS BIGINT) AS missing, count(*) FILTER (NOT {ID_OK}) AS malformed, {r(f'count(*) FILTER ({ID_OK}) / count(*)')} AS valid_share FROM fo GROUP BY 1")
def id_valid(spark, sf):
    return fl.id_quality(fo(spark, sf, "grp", "id_no"), "id_no", ["grp"])


@query("dim_values", f"WITH {SQL_FO} SELECT DISTINCT product AS value FROM fo WHERE product IS NOT NULL")
def dim_values(spark, sf):
    return fl.dim_values(fo(spark, sf, "product"), "product")


@query("date_range", f"WITH {SQL_FO} SELECT {d('min(lock_time)')} AS min_date, {d('max(lock_time)')} AS max_date FROM fo")
def date_range(spark, sf):
    return fl.date_range(fo(spark, sf, "lock_time"), "lock_time", ("2000-01-01", "2000-12-31"))


@query("dedupe_key", f"WITH {SQL_FO} SELECT buyer_id, order_id, {d('pay_time')} AS pay_date FROM fo QUALIFY row_number() OVER (PARTITION BY buyer_id ORDER BY pay_time, order_id) = 1")
def dedupe_key(spark, sf):
    one = first_row(fo(spark, sf, "buyer_id", "order_id", "pay_time"), ["buyer_id"], [F.col("pay_time"), F.col("order_id")])
    return one.select("buyer_id", "order_id", F.to_date("pay_time").alias("pay_date"))


# ---- breakdowns

LSPEC = bd.LockSpec(groups=GROUPS, pay=("1995-06-01", "1999-12-31"), lock_n=N)
LS = f"""ls AS (SELECT * FROM gp WHERE grp IN {isin(GROUPS)} AND pay_time >= DATE '1995-06-01' AND pay_time <= DATE '1999-12-31' AND lock_time <= e + {N})"""


def locked(spark, sf, *cols):
    o = fo(spark, sf, "order_id", "grp", "pay_time", "lock_time", "buyer_id", *cols)
    return bd.lock_slice(o, order_periods(spark), LSPEC)


def by_dim_sql(expr: str, name: str, cond: str = "TRUE", src: str = "ls") -> str:
    cols = []
    for g in GROUPS:
        cols.append(f"CAST(coalesce(sum(n) FILTER (grp = '{g}'), 0) AS BIGINT) AS {g}_locks")
        cols.append(f"{r(f'''coalesce(sum(sh) FILTER (grp = '{g}'), 0)''')} AS {g}_share_pct")
    return f"""SELECT {name}, {', '.join(cols)} FROM (SELECT grp, {expr} AS {name}, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY grp) * 100 AS sh FROM {src} WHERE {cond} GROUP BY grp, {expr})
WHERE {name} IS NOT NULL GROUP BY {name}"""


@query("lock_slice", f"""WITH {SQL_FO}, a AS (SELECT * FROM gp WHERE grp IN {isin(GROUPS)} AND lock_time - INTERVAL 0 DAY >= DATE '1996-01-01' AND lock_time <= DATE '1999-06-30' AND CAST(lock_time AS DATE) - s + 1 <= 30 + 400
  AND NOT (contains(coalesce(product, '-'), '52') OR contains(coalesce(product, '-'), '66')) AND isodow(lock_time) IN (6, 7)),
b AS (SELECT * FROM a QUALIFY count(*) OVER (PARTITION BY buyer_id) = 1) SELECT order_id, grp, {d('lock_time')} AS lock_date FROM b""")
def lock_slice(spark, sf):
    spec = bd.LockSpec(groups=GROUPS, lock=("1996-01-01", "1999-06-30"), lock_n=400, lock_cutoff="start_plus_k", categories=("battery",), day_kind="weekend", repeat_mode="single_only")
    out = bd.lock_slice(fo(spark, sf, "order_id", "grp", "pay_time", "lock_time", "buyer_id", "product"), order_periods(spark), spec)
    return out.select("order_id", "grp", F.to_date("lock_time").alias("lock_date"))


@query("lock_slice_first_order", f"""WITH {SQL_FO}, {LS}, a AS (SELECT * FROM ls WHERE isodow(lock_time) NOT IN (6, 7)) SELECT order_id, grp FROM a QUALIFY row_number() OVER (PARTITION BY buyer_id ORDER BY pay_time, order_id) = 1""")
def lock_slice_first_order(spark, sf):
    spec = bd.LockSpec(groups=GROUPS, pay=("1995-06-01", "1999-12-31"), lock_n=N, day_kind="weekday", repeat_mode="first_order")
    return bd.lock_slice(fo(spark, sf, "order_id", "grp", "pay_time", "lock_time", "buyer_id"), order_periods(spark), spec).select("order_id", "grp")


@query("lock_by_product", f"""WITH {SQL_FO}, {LS}, {PRICES}, x AS (SELECT grp, product, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY grp) * 100 AS sh FROM ls GROUP BY grp, product)
SELECT grp, x.product, n AS locks, {r('sh')} AS share_pct, 'battery' AS category, {r('nullif(price, 0)')} AS list_price FROM x LEFT JOIN pr ON pr.product = x.product WHERE x.product IS NOT NULL""")
def lock_by_product(spark, sf):
    out = bd.lock_by_product(locked(spark, sf, "product"), product_prices(spark, sf))
    return out.withColumn("list_price", F.col("list_price").cast("double"))


@query("lock_by_channel", f"WITH {SQL_FO}, {LS} {by_dim_sql('channel', 'channel')}")
def lock_by_channel(spark, sf):
    return bd.lock_wide(bd.lock_by_dim(locked(spark, sf, "channel"), F.col("channel"), "channel"), "channel", GROUPS)


@query("lock_by_age", f"WITH {SQL_FO}, {LS} {by_dim_sql(B4, 'age_band')}")
def lock_by_age(spark, sf):
    return bd.lock_wide(bd.lock_by_dim(locked(spark, sf, "age"), age_band("age", "lock"), "age_band"), "age_band", GROUPS)


GENDER = "CASE WHEN lower(gender) = 'f' THEN 'female' WHEN lower(gender) = 'p' THEN 'male' ELSE 'unknown' END"


@query("lock_by_gender", f"""WITH {SQL_FO}, {LS} {by_dim_sql(GENDER, 'gender2', GENDER + " <> 'unknown'").replace('gender2', 'gender_class')}""")
def lock_by_gender(spark, sf):
    words = {"male": ("P", "male"), "female": ("F", "female")}
    known = locked(spark, sf, "gender").withColumn("g", rules.normalize_enum("gender", words)).where("g <> 'unknown'")
    return bd.lock_wide(bd.lock_by_dim(known, F.col("g"), "gender_class"), "gender_class", GROUPS)


@query("lock_by_region", f"WITH {SQL_FO}, {LS} {by_dim_sql('region', 'region', '''NOT (contains(region, 'AMERICA') OR contains(region, 'AFRICA'))''')}")
def lock_by_region(spark, sf):
    kept = locked(spark, sf, "region").where(rules.region_type("region", REGION_RULES).isin("traditional", "fac", "unknown"))
    return bd.lock_wide(bd.lock_by_dim(kept, rules.region_norm("region"), "region"), "region", GROUPS)


@query("lock_by_province", f"WITH {SQL_FO}, {LS} {by_dim_sql('region', 'province')}")
def lock_by_province(spark, sf):
    return bd.lock_wide(bd.lock_by_dim(locked(spark, sf, "region"), F.col("region"), "province"), "province", GROUPS)


@query("lock_by_city", f"WITH {SQL_FO}, {LS}, z AS ({by_dim_sql('city', 'city')}) SELECT * FROM z WHERE " + " OR ".join(f"{g}_locks BETWEEN 20 AND 50" for g in GROUPS))
def lock_by_city(spark, sf):
    return bd.lock_wide(bd.lock_by_dim(locked(spark, sf, "city"), F.col("city"), "city"), "city", GROUPS, 20, 50)


LCOLS = [f"{g}_locks" for g in GROUPS]
_TIES = " + ".join(f"CASE WHEN {c} = greatest({', '.join(LCOLS)}) THEN 1 ELSE 0 END" for c in LCOLS)
_PICK = " ".join(f"WHEN {c} = greatest({', '.join(LCOLS)}) THEN '{c}'" for c in LCOLS)


@query("max_highlight", f"WITH {SQL_FO}, {LS}, z AS ({by_dim_sql('city', 'city')}) SELECT city, {', '.join(LCOLS)}, CASE WHEN greatest({', '.join(LCOLS)}) <= 0 OR {_TIES} > 1 THEN NULL {_PICK} END AS max_column FROM z")
def max_highlight(spark, sf):
    w = bd.lock_wide(bd.lock_by_dim(locked(spark, sf, "city"), F.col("city"), "city"), "city", GROUPS)
    return bd.row_max_flag(w, LCOLS).select("city", *LCOLS, "max_column")


RATE_CLASS = "CASE WHEN rt < 5 THEN 'low' WHEN rt < 10 THEN 'mid' ELSE 'high' END"


def refund_sql(dim: str, n: int, cond: str = "TRUE") -> str:
    return f"""x AS (SELECT grp, {dim} AS value, count(*) AS o, count(*) FILTER (refund_time <= s + {n}) AS rf, count(*) FILTER (refund_time <= s + {n}) / count(*) * 100 AS rt
  FROM gp WHERE pay_time <= s + {n} GROUP BY ALL), y AS (SELECT *, sum(o) OVER (PARTITION BY value) AS tot FROM x)
SELECT grp, value, o AS orders, rf AS refunds, {r('rt')} AS refund_rate_pct, {RATE_CLASS} AS rate_class FROM y WHERE {cond}"""


@query("refund_by_region", f"WITH {SQL_FO}, {refund_sql('region', 200)}")
def refund_by_region(spark, sf):
    return bd.refund_by_dim(fo(spark, sf, "grp", "pay_time", "refund_time", "region"), order_periods(spark), "region", 200)


@query("refund_by_city", f"WITH {SQL_FO}, {refund_sql('city', 200, 'tot BETWEEN 250 AND 330')}")
def refund_by_city(spark, sf):
    return bd.refund_by_dim(fo(spark, sf, "grp", "pay_time", "refund_time", "city"), order_periods(spark), "city", 200, 250, 330)


@query("age_stats", f"""WITH {SQL_FO}, {LS}, c AS (SELECT grp, age FROM ls WHERE age BETWEEN 20 AND 70), q AS (SELECT grp, quantile_cont(age, 0.25) AS a, quantile_cont(age, 0.75) AS b FROM c GROUP BY 1),
k AS (SELECT c.grp, age FROM c JOIN q ON q.grp = c.grp WHERE age BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)), n AS (SELECT grp, count(age) AS n FROM ls GROUP BY 1)
SELECT k.grp, {r('avg(age)')} AS mean, {r('median(age)')} AS median, {r('stddev_samp(age)')} AS std_samp, count(*) AS n, n.n - count(*) AS removed FROM k JOIN n ON n.grp = k.grp GROUP BY k.grp, n.n""")
def age_stats(spark, sf):
    return bd.robust_stats(locked(spark, sf, "age"), "age", ["grp"], 20, 70)


# ---- buyers and agents

RB = "rb AS (SELECT buyer_id, count(*) AS n FROM fo WHERE buyer_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"


@query("repeat_buyers", f"WITH {SQL_FO} SELECT CAST(buyer_id AS VARCHAR) AS buyer_key, count(*) AS orders FROM fo GROUP BY 1 HAVING count(*) > 1 AND min(invoice_time) < TIMESTAMP '1996-01-01'")
def repeat_buyers(spark, sf):
    return by.repeat_buyers(fo(spark, sf, "buyer_id", "invoice_time"), "1996-01-01")


@query("repeat_buyers_combo", f"WITH {SQL_FO} SELECT buyer_id || '_' || buyer_phone AS buyer_key, count(*) AS orders FROM fo WHERE buyer_phone IS NOT NULL GROUP BY 1 HAVING count(*) > 1 AND min(invoice_time) < TIMESTAMP '1997-01-01'")
def repeat_buyers_combo(spark, sf):
    return by.repeat_buyers(fo(spark, sf, "buyer_id", "buyer_phone", "invoice_time"), "1997-01-01", "id_phone")


REPEAT = """
rp AS (SELECT period, buyer_id, count(*) AS n FROM ps GROUP BY ALL),
rs AS (SELECT p.grp AS period, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_orders, CAST(coalesce(sum(n) FILTER (n >= 2), 0) AS BIGINT) AS repeat_orders, count(*) FILTER (n >= 2) AS repeat_buyers
  FROM p LEFT JOIN rp ON rp.period = p.grp GROUP BY 1)
"""


def orders_of(spark, sf, *extra):
    return fo(spark, sf, "order_id", "grp", "pay_time", "buyer_id", *extra)


@query("repeat_period", f"WITH {SQL_FO}, {REPEAT} SELECT period, total_orders, repeat_orders, repeat_buyers, {r('coalesce(' + div('repeat_orders', 'total_orders') + ', 0)')} AS repeat_ratio FROM rs")
def repeat_period(spark, sf):
    return by.repeat_stats(orders_of(spark, sf), order_periods(spark))


AGENT = f"""{SQL_REG},
am AS (SELECT ps.*, reg.agent_card IS NOT NULL AS ag FROM ps LEFT JOIN reg ON reg.agent_name = ps.agent_name AND reg.agent_code = ps.agent_id AND reg.agent_card = CAST(ps.buyer_id AS VARCHAR)),
ags AS (SELECT p.grp AS period, count(am.order_id) AS total_orders, count(*) FILTER (ag) AS agent_orders FROM p LEFT JOIN am ON am.period = p.grp GROUP BY 1)
"""


@query("agent_match_period", f"WITH {SQL_FO}, {AGENT} SELECT period, total_orders, agent_orders, {r('coalesce(' + div('agent_orders', 'total_orders') + ', 0)')} AS agent_ratio FROM ags")
def agent_match_period(spark, sf):
    return by.agent_match(orders_of(spark, sf, "agent_name", "agent_id"), order_periods(spark), registry(spark, sf))


@query("ratio_outliers", f"""WITH {SQL_FO}, {AGENT}, z AS (SELECT period, agent_orders / total_orders AS q FROM ags WHERE total_orders > 0), y AS (SELECT *, avg(q) OVER () AS m FROM z)
SELECT period, {r('q')} AS agent_ratio, {r('m')} AS mean_ratio, {r('abs(q - m)')} AS deviation, abs(q - m) > 0.01 AS outlier FROM y""")
def ratio_outliers(spark, sf):
    return by.ratio_outliers(agent_match_period(spark, sf), "agent_ratio", 0.01)


@query("repeat_profile", f"""WITH {SQL_FO}, {RB}, x AS (SELECT unnest(['region', 'city', 'channel', 'gender']) AS dimension, unnest([region, city, channel, gender]) AS value FROM fo WHERE buyer_id IN (SELECT buyer_id FROM rb)),
y AS (SELECT dimension, value, count(*) AS orders FROM x WHERE value IS NOT NULL GROUP BY ALL), z AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY orders DESC, value) AS rank FROM y)
SELECT dimension, value, orders, rank FROM z WHERE rank <= 3 OR dimension = 'channel'""")
def repeat_profile(spark, sf):
    return by.repeat_profile(fo(spark, sf, "buyer_id", "invoice_time", "region", "city", "channel", "gender"), ["region", "city", "channel", "gender"], 3, ["channel"])


GAPS = "gz AS (SELECT CAST(floor((epoch_us(pay_time) - epoch_us(lag(pay_time) OVER (PARTITION BY buyer_id ORDER BY pay_time, order_id))) / 86400000000.0) AS BIGINT) AS g FROM {src} WHERE buyer_id IS NOT NULL)"
COMBO = "cz AS (SELECT buyer_id, string_agg(DISTINCT grp, '+' ORDER BY grp) AS k, count(DISTINCT grp) AS gs, count(*) AS n FROM {src} WHERE buyer_id IS NOT NULL GROUP BY 1)"


@query("repeat_patterns", f"""WITH {SQL_EV}, {GAPS.format(src='ev')}, b AS (SELECT buyer_id, count(*) AS n FROM ev GROUP BY 1 HAVING count(*) >= 2), mx AS (SELECT buyer_id, CASE WHEN order_id % 2 = 0 THEN 'even' ELSE 'odd' END AS grp FROM ev), {COMBO.format(src='mx')}
SELECT 'orders_per_buyer' AS pattern, CAST(n AS VARCHAR) AS key, count(*) AS n FROM b GROUP BY 2
UNION ALL SELECT 'gap_days', CAST(g AS VARCHAR), count(*) FROM gz WHERE g IS NOT NULL GROUP BY 2
UNION ALL SELECT 'combination', k, count(*) FROM cz WHERE n >= 2 AND gs > 1 GROUP BY 2""")
def repeat_patterns(spark, sf):
    e = fact_events(spark, sf).withColumn("invoice_time", F.lit(None).cast("timestamp"))
    return by.repeat_patterns(e.withColumn("grp", F.when(F.col("order_id") % 2 == 0, "even").otherwise("odd")))


@query("repeat_summary", f"""WITH {SQL_FO}, {RB}, {GAPS.format(src='fo')}, mx AS (SELECT buyer_id, channel AS grp FROM fo), {COMBO.format(src='mx')},
g AS (SELECT avg(g) AS a, min(g) AS b, max(g) AS c FROM gz WHERE g IS NOT NULL),
ct AS (SELECT k, count(*) AS n FROM cz WHERE n >= 2 AND gs > 1 GROUP BY 1 ORDER BY n DESC, k LIMIT 5),
x AS (SELECT unnest(['region', 'gender']) AS dimension, unnest([region, gender]) AS value FROM fo WHERE buyer_id IN (SELECT buyer_id FROM rb)),
y AS (SELECT dimension, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY dimension) AS t FROM x GROUP BY dimension, value)
SELECT 'buyers' AS section, 'repeat_buyers' AS key, {r('count(*)')} AS value, CAST(NULL AS DOUBLE) AS share FROM rb
UNION ALL SELECT 'buyers', 'mean_orders', {r('sum(n) / count(*)')}, NULL FROM rb
UNION ALL SELECT 'gap_days', 'mean', {r('a')}, NULL FROM g UNION ALL SELECT 'gap_days', 'min', {r('b')}, NULL FROM g UNION ALL SELECT 'gap_days', 'max', {r('c')}, NULL FROM g
UNION ALL SELECT 'combination', k, {r('n')}, NULL FROM ct
UNION ALL (SELECT 'top_' || dimension, value, {r('n')}, {r('n / t')} FROM y QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) = 1)""")
def repeat_summary(spark, sf):
    o = fo(spark, sf, "order_id", "pay_time", "invoice_time", "buyer_id", "region", "gender", "channel").withColumn("grp", F.col("channel"))
    return by.repeat_summary(o, ["region", "gender"])


@query("repeat_agent", f"""WITH {SQL_FO}, {RB}, {SQL_REG}, x AS (SELECT reg.agent_card IS NOT NULL AS ag FROM fo LEFT JOIN reg ON reg.agent_name = fo.agent_name AND reg.agent_code = fo.agent_id AND reg.agent_card = CAST(fo.buyer_id AS VARCHAR)
WHERE fo.buyer_id IN (SELECT buyer_id FROM rb)) SELECT count(*) AS repeat_orders, count(*) FILTER (ag) AS matched_orders, {r('count(*) FILTER (ag) / count(*)')} AS match_ratio FROM x""")
def repeat_agent(spark, sf):
    return by.repeat_agent(fo(spark, sf, "order_id", "buyer_id", "invoice_time", "agent_name", "agent_id"), registry(spark, sf))


@query("repeat_order_list", f"""WITH {SQL_FO}, v AS (SELECT * FROM fo WHERE {ID_OK}), q AS (SELECT *, coalesce(lock_time >= DATE '1997-01-01' AND lock_time <= DATE '1997-12-31' AND grp = 'BUILDING', false) AS ok FROM v),
k AS (SELECT id_no FROM q GROUP BY 1 HAVING count(*) > 1 AND min(invoice_time) < DATE '1998-01-01' AND count(*) FILTER (ok) > 0)
SELECT id_no AS buyer_id, order_id, {ts('lock_time')} AS lock_time, grp, product, CASE WHEN product IS NULL THEN 'unknown' ELSE 'battery' END AS category, {ts('invoice_time')} AS invoice_time,
CASE WHEN ok THEN 'qualifying' ELSE 'earlier' END AS tag FROM q WHERE id_no IN (SELECT id_no FROM k)""")
def repeat_order_list(spark, sf):
    o = fo(spark, sf, "id_no", "order_id", "lock_time", "grp", "product", "invoice_time").withColumnRenamed("id_no", "buyer_id")
    return by.repeat_order_list(o, "1998-01-01", "1997-01-01", "1997-12-31", "BUILDING")


LOCKED_LIST = "lk AS (SELECT * FROM fo WHERE lock_time >= DATE '1997-01-01' AND lock_time <= DATE '1997-06-30' AND grp = 'BUILDING')"


def _locked_list(spark, sf):
    o = fo(spark, sf, "order_id", "lock_time", "buyer_id", "grp", "invoice_time", "product")
    return by.locked_order_list(o, "1997-01-01", "1997-06-30", "BUILDING")


@query("locked_order_list", f"""WITH {SQL_FO}, {LOCKED_LIST} SELECT order_id, {ts('lock_time')} AS lock_time, buyer_id, grp, {ts('invoice_time')} AS invoice_time, product, CASE WHEN product IS NULL THEN 'unknown' ELSE 'battery' END AS category FROM lk""")
def locked_order_list(spark, sf):
    return _locked_list(spark, sf)


@query("locked_order_days", f"WITH {SQL_FO}, {LOCKED_LIST} SELECT {d('lock_time')} AS date, count(*) AS orders FROM lk GROUP BY 1")
def locked_order_days(spark, sf):
    return by.locks_per_day(_locked_list(spark, sf))


DETAIL = f"""{SQL_REG},
ad AS (SELECT reg.agent_card IS NOT NULL AS is_agent, reg.dealer, fo.agent_name, fo.agent_id, fo.buyer_id, count(*) AS orders FROM fo
  LEFT JOIN reg ON reg.agent_name = fo.agent_name AND reg.agent_code = fo.agent_id AND reg.agent_card = CAST(fo.buyer_id AS VARCHAR)
  WHERE CAST(pay_time AS DATE) >= DATE '1997-05-01' AND CAST(pay_time AS DATE) < DATE '1997-06-01' AND region = 'ASIA' GROUP BY ALL)
"""


def _detail(spark, sf):
    o = fo(spark, sf, "order_id", "pay_time", "region", "buyer_id", "agent_name", "agent_id")
    # one month stands for the one day of a real launch: the fixture has six orders a day
    month = o.withColumn("pay_time", F.date_trunc("month", "pay_time"))
    return by.agent_detail(month, registry(spark, sf), "1997-05-01", "ASIA")


@query("agent_match_detail", f"WITH {SQL_FO}, {DETAIL} SELECT is_agent, dealer, agent_name, agent_id, buyer_id, orders FROM ad")
def agent_match_detail(spark, sf):
    return _detail(spark, sf)


@query("agent_dealers", f"WITH {SQL_FO}, {DETAIL} SELECT dealer, CAST(sum(orders) AS BIGINT) AS orders FROM ad WHERE is_agent GROUP BY 1")
def agent_dealers(spark, sf):
    return by.agent_dealers(_detail(spark, sf))


@query("agent_quality", f"""WITH {SQL_FO}, {DETAIL}, x AS (SELECT CAST(sum(orders) AS BIGINT) AS total_orders, CAST(coalesce(sum(orders) FILTER (is_agent), 0) AS BIGINT) AS matched_orders, count(*) FILTER (is_agent) AS agents,
(SELECT agent_name FROM ad WHERE is_agent ORDER BY orders DESC, agent_name, agent_id, buyer_id LIMIT 1) AS top_agent, max(orders) FILTER (is_agent) AS top_agent_orders,
count(*) FILTER (is_agent AND orders > 1) AS multi_order_agents, {r('avg(orders) FILTER (is_agent AND orders > 1)')} AS mean_orders_of_multi, (sum(orders) - coalesce(sum(orders) FILTER (is_agent), 0)) / sum(orders) AS u FROM ad)
SELECT * EXCLUDE (u), {r('u')} AS unmatched_ratio, CASE WHEN u > 0.5 THEN 'low' WHEN u > 0.2 THEN 'medium' ELSE 'high' END AS level FROM x""")
def agent_quality(spark, sf):
    return by.agent_quality(_detail(spark, sf))


@query("buyer_history", f"""WITH {SQL_FO}, x AS (SELECT *, max(pay_time) OVER w AS pp, max(invoice_time) OVER w AS pi, count(*) OVER (PARTITION BY buyer_id) AS n FROM fo
  WINDOW w AS (PARTITION BY buyer_id ORDER BY pay_time, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT order_id, CAST(coalesce(pp < pay_time, false) OR coalesce(pi < pay_time, false) AS BIGINT) AS is_repeat, n AS orders_of_buyer,
{r('CASE WHEN pi < pay_time THEN (epoch_us(pay_time) - epoch_us(pi)) / 86400000000.0 END')} AS last_invoice_gap_days FROM x""")
def buyer_history(spark, sf):
    o = fo(spark, sf, "order_id", "pay_time", "invoice_time", "buyer_id")
    return by.buyer_history(o).select("order_id", "is_repeat", "orders_of_buyer", "last_invoice_gap_days")


# ---- stores

AS_OF = "1999-06-30"
STORE_COLS = ("order_id", "create_time", "lock_time", "store", "store_city", "store_created", "region")
STORES = f"""
sf0 AS (SELECT store, max(create_time) AS lo, count(order_id) AS orders, count(lock_time) AS locks, max(lock_time) AS ll,
  arg_min(store_city, (create_time, order_id)) AS store_city, arg_min(region, (create_time, order_id)) AS region, arg_min(store_created, (create_time, order_id)) AS sc
  FROM so GROUP BY 1),
ss AS (SELECT *, CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(lo)) / 86400000000.0) AS BIGINT) AS ds, CAST(floor((epoch_us(lo) - epoch_us(CAST(sc AS TIMESTAMP))) / 86400000000.0) AS BIGINT) AS dop,
  CASE WHEN NOT sc <= DATE '{AS_OF}' THEN 'not_open' WHEN floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(lo)) / 86400000000.0) > 10 THEN 'suspected_closed' ELSE 'active' END AS status FROM sf0)
"""
SO = f"so AS (SELECT * FROM fo WHERE store IS NOT NULL AND create_time <= TIMESTAMP '{AS_OF}')"


def stores(spark, sf):
    o = fo(spark, sf, *STORE_COLS).where(F.col("create_time") <= F.lit(AS_OF).cast("timestamp"))
    return o, so.store_status(o, AS_OF, 10)


@query("store_status", f"""WITH {SQL_FO}, {SO}, {STORES} SELECT store, store_city, region, {d('sc')} AS store_created, {ts('lo')} AS last_order_time, ds AS days_since, dop AS days_open, orders, locks, {ts('ll')} AS last_lock_time, status FROM ss""")
def store_status(spark, sf):
    return stores(spark, sf)[1]


_ST = ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in so.STATUSES)


@query("store_status_totals", f"WITH {SQL_FO}, {SO}, {STORES} SELECT count(*) AS stores, {_ST}, {r('''count(*) FILTER (status = 'suspected_closed') / count(*) * 100''')} AS closure_rate_pct FROM ss")
def store_status_totals(spark, sf):
    return so.store_status_totals(stores(spark, sf)[1])


@query("store_by_year", f"""WITH {SQL_FO}, {SO}, {STORES} SELECT year(lo) AS year, {_ST}, count(*) FILTER (status <> 'not_open') AS stores FROM ss GROUP BY 1""")
def store_by_year(spark, sf):
    return so.store_by_year(stores(spark, sf)[1])


def _store_locks(dim: str) -> str:
    return f"""x AS (SELECT {dim}, {_ST} FROM ss WHERE {dim} IS NOT NULL GROUP BY 1), k AS (SELECT {dim}, count(*) AS locks FROM fo WHERE create_time <= TIMESTAMP '{AS_OF}' AND lock_time IS NOT NULL GROUP BY 1)
SELECT x.*, coalesce(locks, 0) AS locks FROM x LEFT JOIN k ON k.{dim} = x.{dim}"""


@query("store_by_region", f"WITH {SQL_FO}, {SO}, {STORES}, {_store_locks('region')}")
def store_by_region(spark, sf):
    o, s = stores(spark, sf)
    return so.store_by_with_locks(o, s, "region")


@query("store_by_city", f"WITH {SQL_FO}, {SO}, {STORES}, {_store_locks('store_city')}")
def store_by_city(spark, sf):
    o, s = stores(spark, sf)
    return so.store_by_with_locks(o, s, "store_city")


_BINS = ", ".join(f"({lo}, {hi if hi is not None else 10 ** 9}, '{x}')" for lo, hi, x in zip(so.RECENCY_EDGES[:-1], so.RECENCY_EDGES[1:], so.RECENCY_LABELS))


@query("store_recency_hist", f"WITH {SQL_FO}, {SO}, {STORES}, b AS (SELECT * FROM (VALUES {_BINS}) AS t(lo, hi, bin)) SELECT bin, (SELECT count(*) FROM ss WHERE ds >= b.lo AND ds < b.hi) AS stores FROM b")
def store_recency_hist(spark, sf):
    return so.recency_hist(stores(spark, sf)[1])


@query("store_city_top", f"WITH {SQL_FO}, {SO}, {STORES} SELECT store_city, count(*) AS stores FROM ss GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def store_city_top(spark, sf):
    return so.store_city_top(stores(spark, sf)[1])


@query("product_distinct_orders", f"WITH {SQL_FO} SELECT trim(product) AS product, count(DISTINCT order_id) AS orders FROM fo WHERE trim(product) <> '' GROUP BY 1")
def product_distinct_orders(spark, sf):
    return so.product_distinct_orders(fo(spark, sf, "order_id", "product"))


# ---- profile

PCOLS = ("grp", "pay_time", "lock_time", "refund_time", "invoice_price", "region", "gender", "age", "product")
_NULLS = " + ".join(f"count(*) - count({c})" for c in PCOLS)


@query("profile_table", f"""WITH {SQL_FO}, x AS (SELECT count(*) AS n, {_NULLS} AS z FROM fo), u AS (SELECT count(*) AS u FROM (SELECT DISTINCT {', '.join(PCOLS)} FROM fo)),
y AS (SELECT *, (1 - z / (n * {len(PCOLS)})) * 100 AS c FROM x, u)
SELECT n AS rows, CAST({len(PCOLS)} AS BIGINT) AS columns, CAST(2 AS BIGINT) AS numeric_columns, CAST(3 AS BIGINT) AS datetime_columns, CAST(4 AS BIGINT) AS text_columns, CAST(z AS BIGINT) AS null_cells, {r('c')} AS completeness_pct, n - u AS duplicate_rows,
CASE WHEN c >= 95 THEN 'excellent' WHEN c >= 90 THEN 'good' WHEN c >= 80 THEN 'fair' ELSE 'poor' END AS grade FROM y""")
def profile_table(spark, sf):
    return pf.profile_table(fo(spark, sf, *PCOLS))


_KIND = {"pay_time": "datetime", "lock_time": "datetime", "refund_time": "datetime", "invoice_price": "numeric", "age": "numeric"}


@query("profile_columns", f"WITH {SQL_FO} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{_KIND.get(c, 'text')}' AS type_class, count(*) - count({c}) AS nulls, {r(f'(count(*) - count({c})) / count(*) * 100')} AS null_pct FROM fo""" for c in PCOLS))
def profile_columns(spark, sf):
    return pf.profile_columns(fo(spark, sf, *PCOLS))


@query("describe_numeric", f"WITH {SQL_FO} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min, {r(f'max({c})')} AS max,
{r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS median, {r(f'quantile_cont({c}, 0.75)')} AS q75 FROM fo""" for c in ("invoice_price", "age")))
def describe_numeric(spark, sf):
    return pf.describe_numeric(fo(spark, sf, "invoice_price", "age"), ["invoice_price", "age"])


@query("date_spans", f"WITH {SQL_FO} " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {ts(f'min({c})')} AS first, {ts(f'max({c})')} AS last FROM fo""" for c in ("pay_time", "lock_time")))
def date_spans(spark, sf):
    return pf.date_spans(fo(spark, sf, "pay_time", "lock_time"), ["pay_time", "lock_time"])


@query("null_profile_filtered", f"""WITH {SQL_FO}, u AS (SELECT buyer_id, min(product) AS v FROM fo WHERE grp = 'BUILDING' GROUP BY 1), t AS (SELECT v, count(*) AS n FROM u WHERE v IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT 'rows' AS section, '' AS value, count(*) AS n, {r('1')} AS share FROM u UNION ALL SELECT 'nulls', '', count(*) - count(v), {r('(count(*) - count(v)) / count(*)')} FROM u
UNION ALL SELECT 'top', v, n, {r('n / (SELECT count(*) FROM u)')} FROM t""")
def null_profile_filtered(spark, sf):
    return pf.null_profile(fo(spark, sf, "grp", "buyer_id", "product").where("grp = 'BUILDING'"), "buyer_id", "product", 10)


# ---- scan

@query("scan_orders", f"""SELECT o_orderkey AS order_id, o_custkey AS buyer_id, {ts('o_orderdate')} AS pay_time, {r('o_totalprice')} AS price FROM orders""")
def scan_orders(spark, sf):
    from launchlens.sources.readers import scan_orders as scan

    names = {"o_orderkey": "order_id", "o_custkey": "buyer_id", "o_orderdate": "pay_time", "o_totalprice": "price"}
    return scan(spark, f"{sf}/orders.parquet", names, ["pay_time"]).select("order_id", "buyer_id", "pay_time", "price")
