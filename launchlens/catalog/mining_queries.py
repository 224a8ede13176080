"""Association queries over line items with part attributes, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchlens.catalog.bindings import table
from launchlens.catalog.registry import div, query, r
from launchlens.operators import mining as mi

COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "p_type", "p_size", "taxed", "big"]


def config(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_tax", "l_extendedprice")
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_size", "p_brand")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "p_type", "p_size", "p_brand",
        (F.col("l_tax") > 0).cast("int").alias("taxed"), (F.col("l_extendedprice") > 40000).alias("big"),
    )


CFG = """
cfg AS (SELECT row_number() OVER () AS id, l_returnflag, l_linestatus, l_linenumber, l_quantity, p_type, p_size, p_brand, CAST(l_tax > 0 AS INT) AS taxed, l_extendedprice > 40000 AS big
  FROM lineitem JOIN part ON p_partkey = l_partkey)
"""


def items_sql(cls: str, columns, sup: float) -> str:
    q = lambda c: f"CASE WHEN {c} <= e.{c}1 THEN 'q1' WHEN {c} <= e.{c}2 THEN 'q2' ELSE 'q3' END"
    value = {"l_quantity": q("l_quantity"), "p_size": q("p_size")}
    parts = []
    for c in columns:
        if c == "taxed":
            parts.append("CASE WHEN taxed = 1 THEN 'taxed=1' END")
        elif c == "big":
            parts.append("CASE WHEN big THEN 'big=True' END")
        else:
            parts.append(f"'{c}=' || {value.get(c, c)}")
    return f"""
cl AS (SELECT *, {cls} AS cls FROM cfg),
sz AS (SELECT cls, count(*) AS rows FROM cl GROUP BY 1),
e AS (SELECT cls, quantile_cont(l_quantity, 1/3) AS l_quantity1, quantile_cont(l_quantity, 2/3) AS l_quantity2, quantile_cont(p_size, 1/3) AS p_size1, quantile_cont(p_size, 2/3) AS p_size2 FROM cl GROUP BY 1),
ro AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT cl.cls, [{', '.join(parts)}] AS items, count(*) AS n FROM cl JOIN e ON e.cls = cl.cls GROUP BY ALL)),
it0 AS MATERIALIZED (SELECT cls, id, n, unnest(items) AS item FROM ro),
fi AS MATERIALIZED (SELECT it0.cls, item, CAST(sum(n) AS BIGINT) AS c, sum(n) / any_value(rows) AS s FROM it0 JOIN sz ON sz.cls = it0.cls WHERE item IS NOT NULL GROUP BY it0.cls, item HAVING sum(n) / any_value(rows) >= {sup}),
it AS MATERIALIZED (SELECT it0.* FROM it0 JOIN fi ON fi.cls = it0.cls AND fi.item = it0.item),
s2 AS (SELECT a.cls, a.item AS i1, b.item AS i2, CAST(sum(a.n) AS BIGINT) AS c FROM it a JOIN it b ON a.id = b.id AND a.item < b.item GROUP BY ALL),
s3 AS (SELECT a.cls, a.item AS i1, b.item AS i2, c.item AS i3, CAST(sum(a.n) AS BIGINT) AS c FROM it a JOIN it b ON a.id = b.id AND a.item < b.item JOIN it c ON c.id = a.id AND b.item < c.item GROUP BY ALL),
fs0 AS (SELECT cls, [item] AS st, c FROM fi UNION ALL SELECT cls, [i1, i2], c FROM s2 UNION ALL SELECT cls, [i1, i2, i3], c FROM s3),
fs AS MATERIALIZED (SELECT fs0.cls, st, len(st) AS size, c, c / rows AS s FROM fs0 JOIN sz ON sz.cls = fs0.cls WHERE c / rows >= {sup})
"""


def rules_sql() -> str:
    cases = [(2, "[st[1]]", "[st[2]]"), (2, "[st[2]]", "[st[1]]")]
    for k, rest in ((1, "[st[2], st[3]]"), (2, "[st[1], st[3]]"), (3, "[st[1], st[2]]")):
        cases += [(3, f"[st[{k}]]", rest), (3, rest, f"[st[{k}]]")]
    return "sp AS (" + " UNION ALL ".join(f"SELECT cls, s, {a} AS a, {c} AS c FROM fs WHERE size = {n}" for n, a, c in cases) + """),
ru AS (SELECT sp.cls, sp.a, sp.c, sp.s, x.s AS sa, y.s AS sc, sp.s / x.s AS cf FROM sp JOIN fs x ON x.cls = sp.cls AND x.st = sp.a JOIN fs y ON y.cls = sp.cls AND y.st = sp.c)
"""


RULES = f"""SELECT cls, array_to_string(a, ' & ') AS antecedent, array_to_string(c, ' & ') AS consequent, {r('s')} AS support, {r('cf')} AS confidence, {r('s / (sa * sc)')} AS lift,
{r('s - sa * sc')} AS leverage, {r(div('1 - sc', '1 - cf'))} AS conviction FROM ru"""


def flat(itemsets):
    return itemsets.select("cls", F.array_join("itemset", " & ").alias("itemset"), "size", "count", "support")


@query("itemize", f"WITH {CFG}, {items_sql(chr(39) + 'all' + chr(39), COLUMNS, 0.05)} SELECT cls, item, c AS count, {r('s')} AS support FROM fi")
def itemize(spark, sf):
    return mi.item_support(mi.itemize(config(spark, sf), COLUMNS, 0.05))


@query("freq_itemsets", f"WITH {CFG}, {items_sql(chr(39) + 'all' + chr(39), COLUMNS, 0.05)} SELECT cls, array_to_string(st, ' & ') AS itemset, size, c AS count, {r('s')} AS support FROM fs")
def freq_itemsets(spark, sf):
    return flat(mi.freq_itemsets(mi.itemize(config(spark, sf), COLUMNS, 0.05), 0.05, 3))


@query("assoc_rules", f"WITH {CFG}, {items_sql(chr(39) + 'all' + chr(39), COLUMNS, 0.05)}, {rules_sql()} {RULES} WHERE s / (sa * sc) >= 1.02 AND cf >= 0.5")
def assoc_rules(spark, sf):
    sets = mi.freq_itemsets(mi.itemize(config(spark, sf), COLUMNS, 0.05), 0.05, 3)
    return mi.assoc_rules(sets, 1.02, 0.5)


BY_COLUMNS = [c for c in COLUMNS if c != "p_type"]


@query("assoc_rules_by", f"WITH {CFG}, {items_sql('p_type', BY_COLUMNS, 0.05)}, {rules_sql()} {RULES} WHERE s / (sa * sc) >= 1.02 AND cf >= 0.5")
def assoc_rules_by(spark, sf):
    sets = mi.freq_itemsets(mi.itemize(config(spark, sf), BY_COLUMNS, 0.05, by="p_type"), 0.05, 3)
    return mi.assoc_rules(sets, 1.02, 0.5)


ONEHOT = ["l_returnflag", "l_linestatus", "p_type", "p_brand"]
_OH = ", ".join(f"'{c}'" for c in ONEHOT)
OH = f"""
oh0 AS (SELECT id, unnest([{_OH}]) AS col, unnest([{', '.join(ONEHOT)}]) AS val FROM cfg),
oh AS (SELECT col, val, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY col) AS sh FROM oh0 GROUP BY col, val)
"""


@query("onehot_support", f"""WITH {CFG}, {OH} SELECT col AS "column", val AS value, n, {r('sh')} AS share FROM oh WHERE sh >= 0.04""")
def onehot_support(spark, sf):
    return mi.onehot_support(config(spark, sf), ONEHOT, 0.04)


@query("interactions", f"""WITH {CFG}, {OH}, k AS (SELECT *, col || '=' || val AS item FROM oh WHERE sh >= 0.03), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, item) AS rk FROM k),
x AS (SELECT id, rk, item FROM oh0 JOIN t ON t.col = oh0.col AND t.val = oh0.val),
y AS (SELECT a.rk AS rank_a, b.rk AS rank_b, a.item AS a, b.item AS b, count(*) AS n FROM x a JOIN x b ON a.id = b.id AND a.rk < b.rk GROUP BY ALL)
SELECT rank_a, rank_b, a, b, n, {r('n / (SELECT count(*) FROM cfg)')} AS joint_support FROM y WHERE n / (SELECT count(*) FROM cfg) >= 0.01""")
def interactions(spark, sf):
    return mi.interactions(config(spark, sf), ONEHOT, 0.03, 0.01)
