"""Price models over line items with part attributes. The linear ones have oracles: normal equations solved in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from launchlens.catalog.bindings import table
from launchlens.catalog.registry import query, r
from launchlens.operators import mining as mi, models as mo

NUMERIC = ["l_quantity", "l_discount", "p_retailprice"]
CATEGORICAL = ["l_returnflag", "p_type"]
#: The one-hot values of the provided tables; all have enough support.
VALUES = {"l_returnflag": ["A", "N", "R"], "p_type": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]}
#: Penalty of the ridge fit that SQL repeats.
PENALTY = 25.0


def price_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_extendedprice")
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_retailprice")
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.withColumn("id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))


def fit(spark, sf, kind, pairs=False, **kw):
    """A fit whose lines of every fifth order are held out."""
    rows = price_rows(spark, sf)
    found = mi.interactions(rows, CATEGORICAL, 0.03, 0.01) if pairs else None
    return mo.price_fit(rows, "l_extendedprice", NUMERIC, CATEGORICAL, kind, pairs=found, held_out=F.col("l_orderkey") % 5 == 0, **kw)


FLAGS = [(f"{c}={v}", f"CAST({c} = '{v}' AS DOUBLE)") for c, vs in VALUES.items() for v in vs]
#: Products of the values of both columns.
PAIRS = [(f"l_returnflag={a}&p_type={b}", f"CAST(l_returnflag = '{a}' AND p_type = '{b}' AS DOUBLE)") for a in VALUES["l_returnflag"] for b in VALUES["p_type"]]
FEATURES = [(c, f"CAST({c} AS DOUBLE)") for c in NUMERIC] + FLAGS


def solved(features: Sequence[tuple[str, str]], penalty: float = 0.0) -> str:
    """CTEs x (held, y, f1, ...) and sol (w, b): Gauss-Jordan steps on the centred normal equations of the rows not held out.

    Without a penalty the values of a column are coded as distances from its last one, so their
    coefficients add up to zero, as in the smallest of all least-squares solutions.
    """
    names = [n for n, _ in features]
    if penalty:
        code = [(f"f{k}", [(k, 1)]) for k in range(1, len(features) + 1)]
    else:
        code = [(f"f{names.index(c) + 1}", [(names.index(c) + 1, 1)]) for c in NUMERIC]
        for c, vs in VALUES.items():
            at = [names.index(f"{c}={v}") + 1 for v in vs]
            code += [(f"(f{k} - f{at[-1]})", [(k, 1), (at[-1], -1)]) for k in at[:-1]]
    p = len(code)
    cell = lambda i, j: f"covar_pop({code[i][0]}, {code[j][0]}) * count(*)" + (f" + {penalty}" if i == j else "")
    lines = ", ".join("[" + ", ".join([*(cell(i, j) for j in range(p)), f"covar_pop({code[i][0]}, y) * count(*)"]) + "]" for i in range(p))
    weight = {k: " ".join(f"{'+' if s > 0 else '-'} m[{i + 1}][{p + 1}]" for i, (_, parts) in enumerate(code) for q, s in parts if q == k) for k in range(1, len(features) + 1)}
    mean = " + ".join(f"w[{k}] * mean[{k}]" for k in range(1, len(features) + 1))
    return f"""x AS MATERIALIZED (SELECT l_orderkey % 5 = 0 AS held, CAST(l_extendedprice AS DOUBLE) AS y, {', '.join(f'{e} AS f{k}' for k, (_, e) in enumerate(features, 1))}
  FROM lineitem JOIN part ON p_partkey = l_partkey),
g0 AS (SELECT [{lines}] AS m, [{', '.join(f'avg(f{k})' for k in range(1, len(features) + 1))}] AS mean, avg(y) AS my FROM x WHERE NOT held),
g(k, m, mean, my) AS (SELECT 1, m, mean, my FROM g0 UNION ALL
  SELECT k + 1, list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {p + 2}), lambda j: CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END)), mean, my FROM g WHERE k <= {p}),
sol AS MATERIALIZED (SELECT w, my - ({mean}) AS b FROM (SELECT [{', '.join(weight[k] for k in range(1, len(features) + 1))}] AS w, mean, my FROM g WHERE k = {p + 1}))"""


def table_sql(features: Sequence[tuple[str, str]], penalty: float = 0.0) -> str:
    """The result of PriceFit.table: errors on the held-out rows, then coefficients."""
    dot = " + ".join(f"w[{k}] * f{k}" for k in range(1, len(features) + 1))
    rows = [("metric", n, f"SELECT {e} FROM er") for n, e in (("r2", "1 - avg(e * e) / any_value(v)"), ("mae", "avg(abs(e))"), ("rmse", "sqrt(avg(e * e))"))]
    rows += [("metric", "penalty", f"SELECT {penalty}")] if penalty else []
    rows += [("feature", n, f"SELECT w[{k}] FROM sol") for k, (n, _) in enumerate(features, 1)]
    return f"""WITH RECURSIVE {solved(features, penalty)},
er AS MATERIALIZED (SELECT y - b - ({dot}) AS e, (SELECT var_pop(y) FROM x WHERE held) AS v FROM x, sol WHERE held)
{' UNION ALL '.join(f"SELECT '{s}' AS section, '{n}' AS name, {r(f'({e})')} AS value" for s, n, e in rows)}"""


@query("price_ols", table_sql(FEATURES))
def price_ols(spark, sf):
    return fit(spark, sf, "ols").table(spark)


@query("price_lasso")
def price_lasso(spark, sf):
    return fit(spark, sf, "lasso", pairs=True).table(spark)


@query("price_ridge")
def price_ridge(spark, sf):
    return fit(spark, sf, "ridge", pairs=True).table(spark)


@query("price_ridge_pairs", table_sql(FEATURES + PAIRS, PENALTY))
def price_ridge_pairs(spark, sf):
    return fit(spark, sf, "ridge", pairs=True, alphas=[PENALTY]).table(spark)


@query("price_gbt")
def price_gbt(spark, sf):
    return fit(spark, sf, "gbt", pairs=True).table(spark)


@query("importance_perm")
def importance_perm(spark, sf):
    return mo.perm_importance(fit(spark, sf, "gbt"))


def importance_sql() -> str:
    """Expected squared error on the held-out rows when one feature is dealt to rows at random, of the least-squares fit."""
    n = len(FEATURES)
    dot = " + ".join(f"w[{k}] * f{k}" for k in range(1, n + 1))
    rise = lambda k: f"SELECT sqrt(avg(e * e) + 2 * any_value(w[{k}]) * covar_pop(f{k}, e) + 2 * any_value(w[{k}]) * any_value(w[{k}]) * var_pop(f{k})) - sqrt(avg(e * e)) FROM er"
    return f"""WITH RECURSIVE {solved(FEATURES)},
er AS MATERIALIZED (SELECT y - b - ({dot}) AS e, w, {', '.join(f'f{k}' for k in range(1, n + 1))} FROM x, sol WHERE held)
{' UNION ALL '.join(f"SELECT '{name}' AS feature, {r(f'({rise(k)})')} AS rise" for k, (name, _) in enumerate(FEATURES, 1))}"""


@query("importance_linear", importance_sql())
def importance_linear(spark, sf):
    return mo.perm_importance(fit(spark, sf, "ols"))
