"""Filters, buyers, agents, stores, breakdowns and shifts on hand-made orders."""

import pytest
from frames import orders, rows_of
from pyspark.sql import functions as F

from launchlens.operators import breakdowns as bd, buyers as by, filters as fl, periods as pr, profile as pf, stores as so, structure as st

P = {"A": ("2024-01-01", "2024-01-10"), "B": ("2024-02-01", "2024-02-10")}


@pytest.fixture(scope="module")
def buyers(spark):
    return orders(
        spark,
        [
            {"buyer_id": "x", "pay_time": "2024-01-01 00:00:00", "invoice_time": "2024-01-03 00:00:00", "lock_time": "2024-01-04 00:00:00"},
            {"buyer_id": "x", "pay_time": "2024-01-05 00:00:00", "lock_time": "2024-01-06 00:00:00", "grp": "B"},
            {"buyer_id": "y", "pay_time": "2024-01-02 00:00:00", "lock_time": "2024-01-07 00:00:00"},
            {"buyer_id": "z", "pay_time": "2024-01-02 00:00:00"},
            {"buyer_id": "z", "pay_time": "2024-01-02 00:00:00", "lock_time": "2024-01-08 00:00:00"},
            {"pay_time": "2024-01-03 00:00:00", "lock_time": "2024-01-09 00:00:00"},
            {"pay_time": "2024-01-04 00:00:00"},
        ],
    )


def test_repeat_buyers(buyers):
    assert rows_of(by.repeat_buyers(buyers), "buyer_key", "orders") == [("x", 2), ("z", 2)]
    assert rows_of(by.repeat_buyers(buyers, "2024-01-04"), "buyer_key") == [("x",)]
    assert rows_of(by.repeat_buyers(buyers, "2024-01-03"), "buyer_key") == []


def test_repeat_filters_partition_the_sample(buyers):
    spec = {"lock": ("2024-01-04", "2024-01-31")}
    every = fl.sample_filter(buyers, fl.SampleSpec(**spec)).count()
    only = fl.sample_filter(buyers, fl.SampleSpec(**spec, repeat_only=True)).count()
    none = fl.sample_filter(buyers, fl.SampleSpec(**spec, exclude_repeat=True)).count()
    both = fl.sample_filter(buyers, fl.SampleSpec(**spec, repeat_only=True, exclude_repeat=True)).count()
    assert (only, none, both) == (2, every - only, 0)


def test_repeat_only_without_repeat_buyers_is_empty(buyers):
    one = buyers.where("buyer_id = 'y'")
    assert fl.sample_filter(one, fl.SampleSpec(repeat_only=True)).count() == 0


def test_buyer_history(buyers):
    out = by.buyer_history(buyers)
    assert rows_of(out, "order_id", "is_repeat", "orders_of_buyer") == [(0, 0, 2), (1, 1, 2), (2, 0, 1), (3, 0, 2), (4, 0, 2), (5, 0, 1), (6, 0, 1)]
    assert {r["order_id"]: r["last_invoice_gap_days"] for r in out.collect()}[1] == 2.0
    shared = {r["order_id"]: (r["is_repeat"], r["orders_of_buyer"]) for r in by.buyer_history(buyers, null_keys="shared").collect()}
    assert (shared[5], shared[6]) == ((0, 2), (1, 2))


def test_gap_counts_include_equal_times(buyers):
    assert rows_of(by.repeat_gap_counts(buyers), "gap_days", "n") == [(0, 1), (4, 1)]
    assert rows_of(by.repeat_combinations(buyers), "combination", "buyers") == [("A+B", 1)]


def test_lock_slice_repeat_modes(spark, buyers):
    p = pr.periods_table(spark, P)
    ids = lambda **kw: [r[0] for r in rows_of(bd.lock_slice(buyers, p, bd.LockSpec(**kw)), "order_id")]
    assert ids() == [0, 1, 2, 4, 5]
    assert ids(repeat_mode="single_only") == [2]
    assert ids(lock=("2024-01-01", "2024-01-31"), repeat_mode="first_order") == [0, 2, 4, 5]
    assert ids(groups=["A"], lock_n=0) == [0, 2, 4, 5]
    assert ids(groups=["A"], lock_n=-2) == [0, 2, 4]
    assert ids(day_kind="weekend") == [1, 2]
    assert ids(day_kind="weekday") == [0, 4, 5]


def test_group_without_period_drops_out_under_a_cutoff(spark, buyers):
    odd = buyers.withColumn("grp", F.when(F.col("order_id") == 2, "C").otherwise(F.col("grp")))
    assert 2 not in [r[0] for r in rows_of(bd.lock_slice(odd, pr.periods_table(spark, P), bd.LockSpec(lock_n=30)), "order_id")]


def test_row_max_flag(spark):
    df = spark.createDataFrame([(1, 2), (2, 2), (0, 0)], "a int, b int")
    assert [r["max_column"] for r in bd.row_max_flag(df, ["a", "b"]).collect()] == ["b", None, None]
    assert [r["max_column"] for r in bd.row_max_flag(df, ["a", "b"], unique=False).collect()] == ["b", "a", None]


def test_robust_stats(spark):
    df = spark.createDataFrame([("A", a) for a in (10.0, 30.0, 31.0, 32.0, 33.0, 80.0, 99.0, None)], "grp string, age double")
    row = bd.robust_stats(df, "age", ["grp"]).first()
    assert (row["mean"], row["median"], row["n"], row["removed"]) == (31.5, 31.5, 4, 3)


def test_agent_match(spark):
    reg = spark.createDataFrame([("Ann", "7", "x", "D1")], "agent_name string, agent_code string, agent_card string, dealer string")
    o = spark.createDataFrame(
        [(1, " Ann ", "7", "x"), (2, "Ann", "7", "y"), (3, None, None, None), (4, "Bob", "7", "x")],
        "order_id int, agent_name string, agent_id string, buyer_id string",
    )
    assert rows_of(by.flag_agent_orders(o, reg).where("is_agent"), "order_id", "dealer") == [(1, "D1")]


def test_store_status(spark):
    o = spark.createDataFrame(
        [(1, "S", "2024-01-01", None, "c2", "2023-01-01"), (2, "S", "2024-01-05", "2024-01-06", "c1", "2023-01-01"), (3, "T", "2024-03-01", None, "c", "2023-05-01"), (4, "U", "2024-03-01", None, "c", "2024-04-01")],
        "order_id long, store string, c string, l string, store_city string, s string",
    ).select("order_id", "store", F.to_timestamp("c").alias("create_time"), F.to_timestamp("l").alias("lock_time"), "store_city", F.to_date("s").alias("store_created"), F.lit("r").alias("region"))
    status = so.store_status(o, "2024-03-02")
    assert rows_of(status, "store", "store_city", "orders", "locks", "days_since", "status") == [
        ("S", "c2", 2, 1, 57, "suspected_closed"), ("T", "c", 1, 0, 1, "active"), ("U", "c", 1, 0, 1, "not_open")]
    assert {r["bin"]: r["stores"] for r in so.recency_hist(status).collect()} == {"0-1": 0, "1-7": 2, "7-30": 0, "30-60": 1, "60-180": 0, "180-365": 0, "365+": 0}
    assert round(so.store_status_totals(status).first()["closure_rate_pct"], 4) == 33.3333


def test_share_shift_counts_missing_as_zero(spark):
    rows = [("T", "n")] * 50 + [("T", "s")] * 50 + [("H1", "s")] * 10 + [("H2", "s")] * 5 + [("H2", "w")] * 5 + [("T", None)]
    df = spark.createDataFrame(rows, "period string, region string")
    out = {r["value"]: r for r in st.share_shift(df, "T", ["H1", "H2"], ["region"], 0.2).collect()}
    assert set(out) == {"n", "s"}  # w is gone from the target, so below the share floor
    assert (out["n"]["direction"], out["n"]["change"]) == ("new", None)
    assert (out["s"]["direction"], out["s"]["base_share"]) == ("down", 0.75)


def test_share_shift_counts_launches_with_only_nulls(spark):
    rows = [("T", "s")] * 10 + [("H1", "s")] * 10 + [("H2", None)] * 3
    out = st.share_shift(spark.createDataFrame(rows, "period string, region string"), "T", ["H1", "H2"], ["region"], 0.2).collect()
    assert [(r["value"], r["base_share"], r["direction"]) for r in out] == [("s", 0.5, "up")]


def test_ab_values_only_in_one_sample(spark):
    a = spark.createDataFrame([("x",)] * 3 + [("y",)] * 3, "gender string")
    b = spark.createDataFrame([("x",)] * 3 + [("z",)] * 3, "gender string")
    out = {r["value"]: r for r in st.ab_shift(a, b, ["gender"], 0.1, floor=None).collect()}
    assert {k: v["kind"] for k, v in out.items()} == {"y": "new", "z": "structure/count"}
    assert out["y"]["relative_change"] is None


def test_refund_dod_checks_every_dimension(spark):
    o = orders(spark, [
        {"pay_time": "2024-01-05 00:00:00", "refund_time": "2024-01-05 01:00:00", "region": "r", "product": "p"},
        {"pay_time": "2024-01-05 00:00:00", "refund_time": "2024-01-05 02:00:00", "region": "r", "product": "q"},
        {"pay_time": "2024-01-04 00:00:00", "refund_time": "2024-01-04 02:00:00", "region": "s", "product": "q"},
    ])
    assert rows_of(st.refund_dod(o, ["region", "product"]), "dimension", "value", "target_n", "base_n", "direction") == [("region", "r", 2, 0, "new")]


def test_profile(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, 1, "x")], "a int, b int, order_time string")
    row = pf.profile_table(df).first()
    assert (row["rows"], row["duplicate_rows"], row["null_cells"], row["datetime_columns"], row["grade"]) == (3, 1, 3, 1, "poor")
    swapped = spark.createDataFrame([(None, 1), (1, None)], "a int, b int")
    assert pf.duplicate_rows(swapped).first()[0] == 0
