"""Queries over training sets, encoders, models and matching.

Fitted models have no SQL form; their feature tables, balance and effect sizes do.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from launchlens.catalog.bindings import SQL_EV, SQL_FO, event_periods, fact_events, fact_orders, order_periods, table
from launchlens.catalog.mining_queries import config
from launchlens.catalog.registry import query, r
from launchlens.operators import causal as ca
from launchlens.operators import evaluation as ev
from launchlens.operators import models as mo
from launchlens.operators.encoding import TargetFreqEncoder
from launchlens.plans.skew import with_row
from launchlens.session import cut_lineage

RULES = (("BUILD", 5000.0), ("MACH", 2000.0))
COLS = ("order_id", "grp", "pay_time", "lock_time", "invoice_time", "buyer_id", "age", "gender", "region", "city", "channel")
SPEC = mo.FeatureSpec(
    numeric=["age", "is_repeat", "orders_of_buyer", "last_invoice_gap_days", "presale_gap_days"], categorical=["gender"], encoded=["channel", "region", "city"]
)


def training(spark, sf):
    return mo.training_set(fact_orders(spark, sf, *COLS), order_periods(spark), RULES)


TRAIN = """
tr0 AS (SELECT fo.* FROM fo WHERE EXISTS (SELECT 1 FROM p WHERE pay_time >= p.s AND pay_time <= p.e)),
tr1 AS (SELECT *, max(pay_time) OVER w AS pp, max(invoice_time) OVER w AS pi, count(*) OVER (PARTITION BY buyer_id) AS n FROM tr0
  WINDOW w AS (PARTITION BY buyer_id ORDER BY pay_time, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tr AS (SELECT tr1.*, CAST(lock_time IS NOT NULL AS BIGINT) AS purchase, CAST(coalesce(pp < pay_time, false) OR coalesce(pi < pay_time, false) AS BIGINT) AS is_repeat,
  CASE WHEN pi < pay_time THEN (epoch_us(pay_time) - epoch_us(pi)) / 86400000000.0 END AS last_gap,
  CASE WHEN pay_time >= p.s THEN (epoch_us(pay_time) - epoch_us(CAST(p.s AS TIMESTAMP))) / 86400000000.0 END AS presale_gap,
  CASE WHEN contains(upper(tr1.grp), 'BUILD') THEN 5000.0 WHEN contains(upper(tr1.grp), 'MACH') THEN 2000.0 END AS deposit FROM tr1 LEFT JOIN p ON p.grp = tr1.grp)
"""


@query("training_set", f"""WITH {SQL_FO}, {TRAIN} SELECT order_id, grp, purchase, is_repeat, n AS orders_of_buyer, {r('last_gap')} AS last_invoice_gap_days, {r('presale_gap')} AS presale_gap_days, {r('deposit')} AS deposit_amount FROM tr""")
def training_set(spark, sf):
    return training(spark, sf).select(
        "order_id", "grp", "purchase", "is_repeat", "orders_of_buyer", "last_invoice_gap_days", "presale_gap_days", "deposit_amount"
    )


@query("target_freq_encode", f"""WITH {SQL_FO}, {TRAIN}, x AS (SELECT purchase AS y, unnest(['region', 'city']) AS col, unnest([region, city]) AS val FROM tr),
g AS (SELECT avg(purchase) AS g, count(*) AS n FROM tr) SELECT col AS "column", val AS value, {r('(sum(y) + 10 * any_value(g)) / (count(*) + 10)')} AS te, {r('count(*) / any_value(g.n)')} AS fe FROM x, g GROUP BY 1, 2""")
def target_freq_encode(spark, sf):
    return TargetFreqEncoder(inputCols=["region", "city"], alpha=10.0).fit(training(spark, sf)).mapping


@query("target_freq_transform", f"""WITH {SQL_FO}, {TRAIN}, g AS (SELECT avg(purchase) AS g, count(*) AS n FROM tr WHERE region <> 'ASIA'),
m AS (SELECT region, (sum(purchase) + 10 * any_value(g)) / (count(*) + 10) AS te, count(*) / any_value(g.n) AS fe FROM tr, g WHERE region <> 'ASIA' GROUP BY 1)
SELECT order_id, {r('coalesce(te, g)')} AS region_te, {r('coalesce(fe, 0)')} AS region_fe FROM tr JOIN g ON true LEFT JOIN m ON m.region = tr.region""")
def target_freq_transform(spark, sf):
    t = cut_lineage(training(spark, sf))
    enc = TargetFreqEncoder(inputCols=["region"]).fit(t.where("region <> 'ASIA'"))
    return enc.transform(t).select("order_id", "region_te", "region_fe")


#: A fixed score column with many ties, and the label it is held against.
SCORED = "SELECT grp, CAST(lock_time IS NOT NULL AS INT) AS y, CAST(age % 17 AS DOUBLE) / 17 AS s FROM fo"


def _scored(spark, sf):
    o = fact_orders(spark, sf, "grp", "age", "lock_time")
    return o.select("grp", F.col("lock_time").isNotNull().cast("int").alias("y"), ((F.col("age") % 17).cast("double") / 17).alias("probability"))


@query("auc_exact", f"""WITH {SQL_FO}, x AS ({SCORED}), c AS (SELECT grp, s, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM x GROUP BY 1, 2)
SELECT a.grp, CAST(any_value(t.pos) AS BIGINT) AS pos, CAST(any_value(t.neg) AS BIGINT) AS neg,
  {r('sum(a.pos * CASE WHEN b.s < a.s THEN b.neg WHEN b.s = a.s THEN b.neg / 2.0 ELSE 0 END) / (any_value(t.pos) * any_value(t.neg))')} AS auc
FROM c a JOIN c b ON a.grp = b.grp JOIN (SELECT grp, sum(pos) AS pos, sum(neg) AS neg FROM c GROUP BY 1) t ON t.grp = a.grp GROUP BY a.grp""")
def auc_exact(spark, sf):
    return ev.auc_by(_scored(spark, sf), "y", ["grp"])


def _report_sql() -> str:
    z = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"
    parts = {}
    for k, (tp, fp, fn) in {"0": ("tn", "fn", "fp"), "1": ("tp", "fp", "fn")}.items():
        p, q = z(tp, f"{tp} + {fp}"), z(tp, f"{tp} + {fn}")
        parts[k] = (tp, fp, fn, [p, q, z(f"2 * {p} * {q}", f"{p} + {q}")], f"({tp} + {fn})")
    n = "(tp + fp + fn + tn)"
    acc = z("tp + tn", n)
    lines = [(k, a, b, c, m, s) for k, (a, b, c, m, s) in parts.items()]
    lines.append(("accuracy", *["NULL"] * 3, [acc] * 3, n))
    lines.append(("macro avg", *["NULL"] * 3, [f"({parts['0'][3][i]} + {parts['1'][3][i]}) / 2" for i in range(3)], n))
    lines.append(("weighted avg", *["NULL"] * 3, [z(f"{parts['0'][3][i]} * {parts['0'][4]} + {parts['1'][3][i]} * {parts['1'][4]}", n) for i in range(3)], n))
    one = lambda k, a, b, c, m, s: f"SELECT grp, '{k}' AS label, CAST({a} AS BIGINT) AS hits, CAST({b} AS BIGINT) AS false_hits, CAST({c} AS BIGINT) AS missed, {r(m[0])} AS precision, {r(m[1])} AS recall, {r(m[2])} AS f1, CAST({s} AS BIGINT) AS support FROM c"
    cells = {"tp": "y = 1 AND s >= 0.5", "fp": "y = 0 AND s >= 0.5", "fn": "y = 1 AND s < 0.5", "tn": "y = 0 AND s < 0.5"}
    return f"WITH {SQL_FO}, x AS ({SCORED}), c AS (SELECT grp, {', '.join(f'count(*) FILTER ({e}) AS {k}' for k, e in cells.items())} FROM x GROUP BY 1) " + " UNION ALL ".join(one(*x) for x in lines)


@query("class_report", _report_sql())
def class_report(spark, sf):
    return ev.class_report(_scored(spark, sf), "y", by=["grp"])


@query("train_conversion")
def train_conversion(spark, sf):
    return mo.train_conversion(training(spark, sf), SPEC).report()


@query("conversion_weights")
def conversion_weights(spark, sf):
    return mo.train_conversion(training(spark, sf), SPEC).weights(spark)


@query("ablation")
def ablation(spark, sf):
    return mo.ablation(training(spark, sf), "deposit_amount", SPEC)


@query("score_batch")
def score_batch(spark, sf):
    t = cut_lineage(training(spark, sf))
    model = mo.fit_classifier(t, "purchase", SPEC, LogisticRegression(maxIter=50, regParam=1e-4, standardization=False))
    day = t.where(F.col("grp") == "BUILDING").agg(F.min(F.to_date("pay_time")).cast("string")).first()[0]
    return mo.mean_score(mo.score_batch(model, t, day, "BUILDING"))


@query("learning_curve")
def learning_curve(spark, sf):
    return mo.learning_curve(training(spark, sf), SPEC)


def _event_rows(spark, sf):
    e = mo.training_set(fact_events(spark, sf), event_periods(spark))
    return e.withColumn("treated", (F.col("grp").isin("G0", "G1")).cast("int")).withColumn("hour", F.hour("pay_time"))


PSM_SPEC = mo.FeatureSpec(numeric=["amount", "hour", "orders_of_buyer"])


def _pairs(spark, sf):
    rows = cut_lineage(_event_rows(spark, sf).select("order_id", "treated", "purchase", *PSM_SPEC.numeric))
    scores = ca.propensity(rows, "treated", PSM_SPEC)
    return rows, scores, cut_lineage(ca.psm_match(scores.scores, "treated"))


@query("psm_match")
def psm_match(spark, sf):
    return _pairs(spark, sf)[2]


@query("psm_effect")
def psm_effect(spark, sf):
    rows, scores, pairs = _pairs(spark, sf)
    kept = pairs.select(F.explode(F.array("treated_key", "control_key")))
    both = ca.balance(scores.smd(), scores.smd(kept))
    effect = ca.att(ca.paired_outcomes(rows, pairs, "purchase"), "treated_outcome", "control_outcome")
    return with_row(both, effect)


@query("psm_check", f"""WITH {SQL_FO}, x AS (SELECT grp IN ('AUTOMOBILE', 'BUILDING') AS t, CAST(age % 23 AS DOUBLE) / 100 + CAST(age AS DOUBLE) / 1000000 AS s FROM fo WHERE grp <> 'MACHINERY' AND (grp <> 'HOUSEHOLD' OR age % 2 = 0)),
c AS (SELECT s, count(*) FILTER (t) AS a, count(*) FILTER (NOT t) AS b FROM x GROUP BY 1)
SELECT CAST(sum(least(a, b)) AS BIGINT) AS same_score, CAST(0 AS BIGINT) AS reused, CAST(0 AS BIGINT) AS beyond_caliper, CAST(0 AS BIGINT) AS still_possible FROM c""")
def psm_check(spark, sf):
    """The rules of the match over a fixed score column: all equal scores paired, no reuse, none beyond the caliper, no possible pair left."""
    o = fact_orders(spark, sf, "order_id", "grp", "age").where("grp <> 'MACHINERY' and (grp <> 'HOUSEHOLD' or age % 2 = 0)")
    rows = cut_lineage(o.select("order_id", F.col("grp").isin("AUTOMOBILE", "BUILDING").cast("int").alias("t"), ((F.col("age") % 23).cast("double") / 100 + F.col("age").cast("double") / 1000000).alias("score")))
    return ca.match_check(rows, cut_lineage(ca.psm_match(rows, "t", caliper=0.03)), "t", 0.03)


def _sm(f: str) -> str:
    t, c = f"CASE WHEN grp IN ('AUTOMOBILE', 'BUILDING') THEN {f} END", f"CASE WHEN grp NOT IN ('AUTOMOBILE', 'BUILDING') THEN {f} END"
    return f"SELECT '{f}' AS feature, {r(f'abs((avg({t}) - avg({c})) / sqrt((var_samp({t}) + var_samp({c})) / 2))')} AS smd FROM fo"


@query("smd", f"WITH {SQL_FO} {_sm('age')} UNION ALL {_sm('invoice_price')}")
def smd(spark, sf):
    o = fact_orders(spark, sf, "grp", "age", "invoice_price").withColumn("t", F.col("grp").isin("AUTOMOBILE", "BUILDING").cast("int"))
    return ca.smd(o, "t", ["age", "invoice_price"])


@query("att", f"""WITH {SQL_FO}, pr AS (SELECT CAST(a.lock_time IS NOT NULL AS INT) - CAST(b.lock_time IS NOT NULL AS INT) AS d FROM fo a JOIN fo b ON b.order_id = a.order_id + 1 WHERE a.order_id % 2 = 0),
x AS (SELECT count(*) AS n, avg(d) AS m, stddev_samp(d) AS s FROM pr) SELECT n AS pairs, {r('m')} AS att, {r('m - 1.96 * s / sqrt(n)')} AS ci_low, {r('m + 1.96 * s / sqrt(n)')} AS ci_high FROM x""")
def att(spark, sf):
    o = fact_orders(spark, sf, "order_id", "lock_time").withColumn("locked", F.col("lock_time").isNotNull().cast("int"))
    pairs = o.where(F.col("order_id") % 2 == 0).select(F.col("order_id").alias("treated_key"), (F.col("order_id") + 1).alias("control_key"))
    return ca.att(ca.paired_outcomes(o, pairs, "locked"), "treated_outcome", "control_outcome")


def _mix(spark, sf):
    o = fact_orders(spark, sf, "order_id", "age", "gender", "city", "region", "lock_time")
    labeled = o.where(F.col("lock_time").isNotNull()).withColumn("label", (F.col("age") < 40).cast("int"))
    return mo.mix_inference(labeled, o, "label", ["age"], ["gender", "city", "region"])


@query("mix_inference")
def mix_inference(spark, sf):
    return _mix(spark, sf).result


@query("mix_report")
def mix_report(spark, sf):
    """Held-out report lines and importances of the forest behind the mix."""
    mix = _mix(spark, sf)
    lines = mix.report.select(F.lit("report").alias("section"), F.col("label").alias("name"), "precision", "recall", "f1", "support", "auc")
    none = F.lit(None)
    gains = mix.importances.select(
        F.lit("importance").alias("section"), F.col("feature").alias("name"), none.cast("double").alias("precision"), none.cast("double").alias("recall"),
        F.col("importance").alias("f1"), none.cast("long").alias("support"), none.cast("double").alias("auc"),
    )
    return lines.unionByName(gains.withColumnRenamed("f1", "importance"), allowMissingColumns=True)


AGE_SEG = "CASE WHEN age > 0 AND age <= 25 THEN '<25' WHEN age > 25 AND age <= 35 THEN '25-35' WHEN age > 35 AND age <= 45 THEN '35-45' WHEN age > 45 AND age <= 55 THEN '45-55' WHEN age > 55 AND age <= 100 THEN '55+' END"


@query("mix_segments", f"""WITH {SQL_FO}, x AS (SELECT invoice_price / 200000 AS pr, unnest(['gender', 'region', 'age']) AS segment, unnest([gender, region, {AGE_SEG}]) AS value FROM fo)
SELECT segment, value, {r('avg(pr)')} AS mean_probability, count(pr) AS orders FROM x WHERE value IS NOT NULL GROUP BY 1, 2 HAVING segment <> 'region' OR count(pr) >= 50""")
def mix_segments(spark, sf):
    return mo.mix_segments(fact_orders(spark, sf, "gender", "region", "age", "invoice_price").withColumn("probability", F.col("invoice_price") / 200000))
