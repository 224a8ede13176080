"""What plans read: sources once, needed columns only, and tables with map columns."""

from frames import orders
from pyspark.sql import functions as F

from launchlens.operators import buyers as bu, filters as fi, profile as pr


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def saved(spark, tmp_path, rows):
    path = str(tmp_path / "orders")
    orders(spark, rows).withColumns({"agent_name": F.lit("a"), "agent_id": F.lit("1"), "w1": F.lit(7)}).write.parquet(path)
    return spark.read.parquet(path)


ROWS = [
    {"buyer_id": "b1", "pay_time": "2024-01-01", "invoice_time": "2024-01-02"}, {"buyer_id": "b1", "pay_time": "2024-01-05"},
    {"buyer_id": None, "pay_time": "2024-01-05"}, {"buyer_id": None, "pay_time": "2024-01-06"}, {"buyer_id": "1", "pay_time": "2024-01-07"},
]


def test_buyer_history_reads_its_source_once(spark, tmp_path):
    out = bu.buyer_history(saved(spark, tmp_path, ROWS))
    assert "FileScan" not in plan(out)
    got = {r["order_id"]: (r["is_repeat"], r["orders_of_buyer"], r["last_invoice_gap_days"]) for r in out.collect()}
    assert got == {0: (0, 2, None), 1: (1, 2, 3.0), 2: (0, 1, None), 3: (0, 1, None), 4: (0, 1, None)}


def test_agent_match_reads_needed_columns_only(spark, tmp_path):
    registry = spark.createDataFrame([("a", "1", "1", "d")], "agent_name string, agent_code string, agent_card string, dealer string")
    counts = bu.flag_agent_orders(saved(spark, tmp_path, ROWS), registry).groupBy("is_agent").count()
    assert {r["is_agent"]: r["count"] for r in counts.collect()} == {True: 1, False: 4}
    assert "w1" not in plan(counts) and "lock_time" not in plan(counts)


def test_map_columns(spark, tmp_path):
    df = saved(spark, tmp_path, ROWS).withColumn("extra", F.create_map(F.lit("k"), F.col("order_id")))
    registry = spark.createDataFrame([("a", "1", "1", "d")], "agent_name string, agent_code string, agent_card string, dealer string")
    assert bu.flag_agent_orders(df, registry).where("is_agent").count() == 1
    assert fi.sample_filter(df, fi.SampleSpec(exclude_repeat=True)).count() == 3
    assert fi.sample_filter(df, fi.SampleSpec(repeat_only=True)).count() == 2
    assert pr.duplicate_rows(df.union(df)).first()["duplicate_rows"] == 5
