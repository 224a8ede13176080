"""The provided tables bound to the operators' canonical columns, in Spark and in oracle SQL.

fact_orders: one row per order; lock / refund / invoice are derived from its line items.
fact_events: one row per signup; lock / refund / assign are the user's first later
purchase / error / view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from launchlens.functions.semantics import micros
from launchlens.operators.periods import periods_table
from launchlens.plans.skew import running_extreme

ORDER_PERIODS = {
    "AUTOMOBILE": ("1996-01-01", "1996-12-31"),
    "BUILDING": ("1997-01-01", "1997-12-31"),
    "FURNITURE": ("1998-01-01", "1998-12-31"),
    "HOUSEHOLD": ("1999-01-01", "1999-12-31"),
    "MACHINERY": ("1997-07-01", "1998-06-30"),
}
EVENT_PERIODS = {
    "G0": ("2024-01-02", "2024-01-12"),
    "G1": ("2024-01-04", "2024-01-14"),
    "G2": ("2024-01-06", "2024-01-16"),
    "G3": ("2024-01-08", "2024-01-18"),
    "G4": ("2024-01-10", "2024-01-20"),
}
ORDER_GROUPS, EVENT_GROUPS = list(ORDER_PERIODS), list(EVENT_PERIODS)
N_ORDERS, N_EVENTS = 180, 5
TOKENS = ("ring", "widget")

LINE_COLUMNS = {"lock_time", "refund_time", "invoice_time", "deposit_time", "invoice_price", "store_id", "product_id"}
STORE_COLUMNS = {"store", "store_created", "agent_id", "agent_name"}
ALL_ORDER_COLUMNS = (
    "order_id", "grp", "pay_time", "create_time", "lock_time", "refund_time", "invoice_time", "deposit_time", "invoice_price",
    "store", "store_city", "store_created", "region", "city", "channel", "gender", "age", "buyer_id", "buyer_phone", "id_no",
    "product", "product_class", "agent_name", "agent_id",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id_no(buyer: Column) -> Column:
    return F.concat(F.lpad((buyer * 7919 + 11).cast("string"), 17, "1"), (buyer % 10).cast("string"))


def fact_orders(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Only the joins that the asked columns need are part of the plan."""
    want = list(columns) or list(ALL_ORDER_COLUMNS)
    need = set(want)
    o = table(spark, sf_dir, "orders").withColumn("pay_time", F.col("o_orderdate").cast("timestamp"))
    out = o
    if need & {"grp", "region", "city", "store_city"}:
        out = out.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), out.o_custkey == F.col("c_custkey"))
    if need & {"region", "city", "store_city"}:
        n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        out = out.join(n.select("n_nationkey", "n_name", "r_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    if need & (LINE_COLUMNS | STORE_COLUMNS | {"product", "product_class"}):
        line = table(spark, sf_dir, "lineitem").withColumn("ship", F.col("l_shipdate").cast("timestamp"))
        if need & {"lock_time", "refund_time", "invoice_time", "deposit_time"}:
            line = line.join(o.select(F.col("o_orderkey").alias("_ok"), F.col("pay_time").alias("_pay")), F.col("l_orderkey") == F.col("_ok"))
            later = F.col("ship") >= F.col("_pay")
        else:
            later = F.lit(True)
        li = line.groupBy("l_orderkey").agg(
            F.min(F.when((F.col("l_linestatus") == "F") & later, F.col("ship"))).alias("lock_time"),
            F.min(F.when((F.col("l_returnflag") == "R") & later, F.col("ship"))).alias("refund_time"),
            F.max(F.when((F.col("l_returnflag") == "A") & later, F.col("ship"))).alias("invoice_time"),
            F.min("l_suppkey").alias("store_id"),
            F.min("l_partkey").alias("product_id"),
            F.max("l_extendedprice").alias("invoice_price"),
        )
        out = out.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    if need & {"product", "product_class"}:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
        out = out.join(part, F.col("product_id") == F.col("p_partkey"), "left")
    buyer, store, key = F.col("o_custkey"), F.col("store_id"), F.col("o_orderkey")
    exprs = {
        "order_id": key,
        "grp": F.col("c_mktsegment"),
        "pay_time": F.col("pay_time"),
        "create_time": F.col("pay_time"),
        "lock_time": F.col("lock_time"),
        "refund_time": F.col("refund_time"),
        "invoice_time": F.col("invoice_time"),
        "deposit_time": F.col("invoice_time"),
        "invoice_price": F.col("invoice_price"),
        "store": F.concat(F.lit("S"), store.cast("string")),
        "store_city": F.col("n_name"),
        "store_created": F.date_add(F.lit("1995-01-01").cast("date"), (store * 37 % 2500).cast("int")),
        "region": F.col("r_name"),
        "city": F.col("n_name"),
        "channel": F.col("o_orderpriority"),
        "gender": F.col("o_orderstatus"),
        "age": (15 + buyer % 60).cast("int"),
        "buyer_id": buyer,
        "buyer_phone": F.when(key % 10 != 0, F.concat(F.lit("P"), (key % 3).cast("string"))),
        "id_no": _id_no(buyer),
        "product": F.col("p_name"),
        "product_class": F.col("p_type"),
        "agent_id": (store % 10).cast("string"),
        "agent_name": F.concat(F.lit("A"), (store % 10).cast("string")),
    }
    return out.select(*[exprs[c].alias(c) for c in want])


def order_periods(spark: SparkSession) -> DataFrame:
    return periods_table(spark, ORDER_PERIODS)


def event_periods(spark: SparkSession) -> DataFrame:
    return periods_table(spark, EVENT_PERIODS)


def fact_events(spark: SparkSession, sf_dir: str, *want: str) -> DataFrame:
    """All columns, or only those asked for; later events of the user are looked up only if asked for."""
    later = {"lock_time": "purchase", "refund_time": "error", "assign_time": "view"}
    later = {c: k for c, k in later.items() if not want or c in want}
    kinds = ("signup", *later.values())
    ev = (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin(*kinds))
        .select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    )
    at = lambda kind: F.when(F.col("event_type") == kind, F.col("ts"))
    linked = ev
    if later:
        linked = running_extreme(ev, ["user_id"], micros("ts"), F.to_date("ts"), {c: ("min", at(k)) for c, k in later.items()}, later=True)
    rows = linked.where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("order_id"),
        F.concat(F.lit("G"), (F.col("user_id") % 5).cast("string")).alias("grp"),
        F.col("user_id").alias("buyer_id"),
        F.col("ts").alias("pay_time"),
        F.col("value").alias("amount"),
        *later,
    )
    return rows.select(*want) if want else rows


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    code = (F.col("c_custkey") % 10).cast("string")
    return c.select(
        F.concat(F.lit("A"), code).alias("agent_name"), code.alias("agent_code"),
        F.col("c_custkey").cast("string").alias("agent_card"), F.col("c_mktsegment").alias("dealer"),
    )


def product_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product name -> class: the type of the first part of that name, ECONOMY names left out."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("product")).agg(F.min_by("p_type", "p_partkey").alias("attr"))
    return p.where(F.col("attr") != "ECONOMY")


def product_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product name -> list price; names containing 'blue' have price 0, so none."""
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_name").alias("product")).agg(F.floor(F.min("p_retailprice")).alias("price")).withColumn(
        "price", F.when(F.col("product").contains("blue"), F.lit(0)).otherwise(F.col("price")).cast("long")
    )


def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day, one column per type."""
    kinds = ("click", "error", "purchase", "signup", "view")
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(
        *[F.count_if(F.col("event_type") == k).alias(k) for k in kinds]
    )


def _values(periods: dict[str, tuple[str, str]]) -> str:
    rows = ", ".join(f"('{g}', DATE '{s}', DATE '{e}')" for g, (s, e) in periods.items())
    return f"(SELECT * FROM (VALUES {rows}) AS t(grp, s, e))"


SQL_FO = f"""
p AS {_values(ORDER_PERIODS)},
li AS (
  SELECT o.o_orderkey AS k,
    MIN(CASE WHEN l.l_linestatus = 'F' AND l.l_shipdate >= o.o_orderdate THEN l.l_shipdate END) AS lock_time,
    MIN(CASE WHEN l.l_returnflag = 'R' AND l.l_shipdate >= o.o_orderdate THEN l.l_shipdate END) AS refund_time,
    MAX(CASE WHEN l.l_returnflag = 'A' AND l.l_shipdate >= o.o_orderdate THEN l.l_shipdate END) AS invoice_time,
    MIN(l.l_suppkey) AS store_id, MIN(l.l_partkey) AS product_id, MAX(l.l_extendedprice) AS invoice_price
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey),
fo AS (
  SELECT o.o_orderkey AS order_id, c.c_mktsegment AS grp, o.o_orderdate AS pay_time, o.o_orderdate AS create_time,
    li.lock_time, li.refund_time, li.invoice_time, li.invoice_time AS deposit_time, li.invoice_price,
    'S' || li.store_id AS store, n.n_name AS store_city,
    DATE '1995-01-01' + CAST(li.store_id * 37 % 2500 AS INTEGER) AS store_created,
    r.r_name AS region, n.n_name AS city, o.o_orderpriority AS channel, o.o_orderstatus AS gender,
    15 + CAST(o.o_custkey % 60 AS INT) AS age, o.o_custkey AS buyer_id,
    CASE WHEN o.o_orderkey % 10 <> 0 THEN 'P' || (o.o_orderkey % 3) END AS buyer_phone,
    lpad(CAST(o.o_custkey * 7919 + 11 AS VARCHAR), 17, '1') || (o.o_custkey % 10) AS id_no,
    p2.p_name AS product, p2.p_type AS product_class,
    CAST(li.store_id % 10 AS VARCHAR) AS agent_id, 'A' || (li.store_id % 10) AS agent_name
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN li ON li.k = o.o_orderkey LEFT JOIN part p2 ON p2.p_partkey = li.product_id),
gp AS (SELECT fo.*, p.s, p.e FROM fo JOIN p ON p.grp = fo.grp),
ps AS (SELECT fo.*, p.grp AS period, p.s, p.e FROM fo JOIN p ON fo.pay_time >= p.s AND fo.pay_time <= p.e)
"""

SQL_EV = f"""
p AS {_values(EVENT_PERIODS)},
ev AS (
  SELECT s.event_id AS order_id, 'G' || (s.user_id % 5) AS grp, s.user_id AS buyer_id, s.ts AS pay_time, s.value AS amount,
    MIN(CASE WHEN e.event_type = 'purchase' THEN e.ts END) AS lock_time,
    MIN(CASE WHEN e.event_type = 'error' THEN e.ts END) AS refund_time,
    MIN(CASE WHEN e.event_type = 'view' THEN e.ts END) AS assign_time
  FROM events s LEFT JOIN events e ON e.user_id = s.user_id AND e.ts > s.ts AND e.event_type IN ('purchase', 'error', 'view')
  WHERE s.event_type = 'signup' GROUP BY s.event_id, s.user_id, s.ts, s.value),
gp AS (SELECT ev.*, p.s, p.e FROM ev JOIN p ON p.grp = ev.grp),
ps AS (SELECT ev.*, p.grp AS period, p.s, p.e FROM ev JOIN p ON ev.pay_time >= p.s AND ev.pay_time <= p.e)
"""

SQL_REG = """
reg AS (SELECT 'A' || (c_custkey % 10) AS agent_name, CAST(c_custkey % 10 AS VARCHAR) AS agent_code,
  CAST(c_custkey AS VARCHAR) AS agent_card, c_mktsegment AS dealer FROM customer)
"""

SQL_DAILY = """
dm AS (SELECT CAST(ts AS DATE) AS date, count(*) FILTER (event_type = 'click') AS click,
  count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase,
  count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view
  FROM events GROUP BY 1)
"""
