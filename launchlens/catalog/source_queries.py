"""Queries over scans and sinks: the tables are written in a source's own format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from launchlens.catalog.bindings import table
from launchlens.catalog.registry import d, query, r
from launchlens.session import shared_folder
from launchlens.sources import readers as rd


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_csv", f"SELECT c_custkey, trim(c_name) AS c_name, c_mktsegment, {r('c_acctbal')} AS c_acctbal FROM customer")
def scan_csv(spark, sf):
    path = scratch(spark, "customer-csv")
    rd.write_table(table(spark, sf, "customer"), path, "csv")
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return rd.scan_csv(spark, path, schema, latest=False).select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


@query("scan_csv_mixed", f"SELECT c_custkey, '客户' || c_name AS c_name, {r('c_acctbal')} AS c_acctbal FROM customer")
def scan_csv_mixed(spark, sf):
    """Files of one folder in two encodings: every third segment in one that Spark's reader does not take."""
    path = scratch(spark, "customer-mixed")
    c = table(spark, sf, "customer")
    rows = c.select(F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit("客户"), "c_name"), F.col("c_acctbal").cast("string")).alias("value"), "c_mktsegment")
    wide = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    encode = F.pandas_udf(lambda s: s.map(lambda v: v.encode("gb18030")), "binary")
    # raw bytes as text lines, under a header of their own
    head = lambda part, name: part.select(F.col("value").cast("string")).write.option("lineSep", "\n").mode("append").text(f"{path}/{name}")
    head(rows.where(~wide), "a")
    head(rows.where(wide).select(encode("value").alias("value")), "b")
    schema = "c_custkey bigint, c_name string, c_acctbal double"
    return rd.scan_csv(spark, f"{path}/*/part-*", schema, latest=False, header=False)


@query("scan_registry", "SELECT c_name AS agent_name, CAST(c_custkey AS VARCHAR) AS agent_code, CAST(c_nationkey AS VARCHAR) AS agent_card, c_mktsegment AS dealer FROM customer WHERE c_custkey % 10 <> 3")
def scan_registry(spark, sf):
    c = table(spark, sf, "customer")
    # padded, some keys blank, documents of at most 500 agents
    agent = F.struct(
        F.concat(F.lit(" "), "c_name").alias("Member Name"),
        F.when(F.col("c_custkey") % 10 != 3, F.col("c_custkey").cast("string")).otherwise(" ").alias("Member Code"),
        F.col("c_nationkey").cast("string").alias("Id Card"),
        F.col("c_mktsegment").alias("Dealer Name Fc"),
    )
    docs = c.groupBy(F.floor(F.col("c_custkey") / 500).alias("g")).agg(F.collect_list(agent).alias("data"))
    path = scratch(spark, "registry")
    rd.write_table(docs.select("data"), path, "json")
    return rd.scan_registry(spark, path, multi_line=False).select("agent_name", "agent_code", "agent_card", "dealer")


#: Names in one document of a written definition.
NAMES_PER_DOCUMENT = 500


def _definition(spark, sf) -> str:
    """A business definition derived from the tables, as JSON lines: launches by segment, and product names in slices by a hash.

    No document grows with the tables: a segment's launch, or some hundred names of one type.
    """
    path = scratch(spark, "definition")
    span = F.struct(
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("start"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("end")
    )
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    spans = o.groupBy("c_mktsegment").agg(span.alias("w"))
    rd.write_table(spans.select(F.create_map("c_mktsegment", "w").alias("time_periods")), f"{path}/periods", "json")
    part = table(spark, sf, "part")
    slices = max(-(-part.count() // NAMES_PER_DOCUMENT), 1)
    slice_ = F.pmod(F.xxhash64("p_name"), F.lit(slices)).alias("_s")
    names = part.groupBy("p_type", slice_).agg(F.sort_array(F.collect_set("p_name")).alias("n"))
    rd.write_table(names.select(F.create_map("p_type", "n").alias("battery_types")), f"{path}/types", "json")
    price = part.groupBy("p_name").agg(F.floor(F.min("p_retailprice")).alias("p")).groupBy(slice_).agg(F.collect_list(F.struct("p_name", "p")).alias("all"))
    rd.write_table(price.select(F.map_from_entries("all").alias("vehicle_prices")), f"{path}/prices", "json")
    return f"{path}/*/part-*"


@query("load_periods", f"SELECT c_mktsegment AS grp, {d('min(o_orderdate)')} AS start_date, {d('max(o_orderdate)')} AS end_date FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def load_periods(spark, sf):
    return rd.load_periods(spark, _definition(spark, sf), lines=True)


@query("load_attr_map", "SELECT DISTINCT p_name AS product, p_type AS attr FROM part")
def load_attr_map(spark, sf):
    return rd.load_attr_map(spark, _definition(spark, sf), "battery_types", lines=True)


@query("load_prices", "SELECT p_name AS product, CAST(floor(min(p_retailprice)) AS BIGINT) AS price FROM part GROUP BY 1")
def load_prices(spark, sf):
    return rd.load_attr_map(spark, _definition(spark, sf), "vehicle_prices", lines=True)


@query("sink_table", "SELECT f AS format, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders, (SELECT unnest(['csv', 'json', 'parquet']) AS f) GROUP BY 1")
def sink_table(spark, sf):
    orders = table(spark, sf, "orders").withColumn("tags", F.array("o_orderstatus", "o_orderpriority"))
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = scratch(spark, f"orders-{fmt}")
        rd.write_table(orders, path, fmt)
        reader = spark.read.option("header", True)
        back = reader.csv(path) if fmt == "csv" else reader.json(path) if fmt == "json" else reader.parquet(path)
        part = back.agg(F.lit(fmt).alias("format"), F.count("*").alias("rows"), F.sum(F.col("o_orderkey").cast("long")).alias("keys"))
        out = part if out is None else out.unionByName(part)
    return out
