"""Boundary rules: whole-day floor, period ends, windows, bands, identity numbers."""

from frames import orders, rows_of
from pyspark.sql import functions as F

from launchlens.functions import rules, semantics as sm
from launchlens.operators import cohorts as co, curves as cv, periods as pr


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def ts(x):
    return F.lit(x).cast("timestamp")


def test_whole_days_floor(spark):
    assert one(spark, sm.interval_days(ts("2024-01-02 12:00:00"), ts("2024-01-02 00:00:00"))) == -1
    assert one(spark, sm.interval_days(ts("2024-01-01 12:00:00"), ts("2024-01-03 11:59:59"))) == 1
    assert one(spark, sm.interval_days(ts("2024-01-01 12:00:00"), ts("2024-01-02 00:00:00"), whole=False)) == 0.5


def test_day_numbers(spark):
    assert one(spark, sm.day_index(ts("2024-01-05 23:00:00"), F.lit("2024-01-05").cast("date"))) == 1
    assert one(spark, sm.days_from_end(ts("2024-01-05 23:00:00"), F.lit("2024-01-05").cast("date"))) == 0


P = {"A": ("2024-01-01", "2024-01-10")}


def edge_orders(spark):
    return orders(
        spark,
        [
            {"pay_time": "2024-01-01 00:00:00", "lock_time": "2024-01-10 00:00:00"},
            {"pay_time": "2024-01-10 00:00:00", "lock_time": "2024-01-13 00:00:00"},
            {"pay_time": "2024-01-10 12:00:00", "lock_time": "2024-01-12 23:59:59.999999"},
            {"pay_time": "2023-12-31 23:59:59", "refund_time": "2024-01-02 00:00:00"},
            {"grp": "B", "pay_time": "2024-01-05 00:00:00"},
        ],
    )


def test_period_end_modes(spark):
    p, o = pr.periods_table(spark, P), edge_orders(spark)
    assert rows_of(pr.presale(o, p), "order_id") == [(0,), (1,)]
    assert rows_of(pr.presale(o, p, "whole_day"), "order_id") == [(0,), (1,), (2,)]
    assert rows_of(pr.period_slice(o, p), "order_id") == [(0,), (1,), (4,)]
    assert rows_of(pr.period_slice(o, p, "whole_day"), "order_id") == [(0,), (1,), (2,), (4,)]


def test_lock_windows(spark):
    p, o = pr.periods_table(spark, P), edge_orders(spark)
    assert rows_of(pr.lock_window_filter(o, p, 3), "order_id") == [(0,), (2,)]  # half-open
    row = co.launch_summary(o, p, 3).first()  # closed on calendar days
    assert (row["locks"], row["retained_locks"], row["post_launch_locks"]) == (3, 3, 0)
    assert (row["presale_days"], row["presale_orders"]) == (10, 4)


def test_daily_curve_keeps_end_day(spark):
    curve = cv.daily_curve(edge_orders(spark), pr.periods_table(spark, P))
    assert rows_of(curve, "day", "daily_orders", "cumulative_orders") == [(1, 1, 1), (10, 2, 3)]


def test_overlapping_periods(spark):
    p = pr.periods_table(spark, {"A": ("2024-01-01", "2024-01-10"), "B": ("2024-01-05", "2024-01-20"), "C": ("2024-03-01", "2024-03-02")})
    o = orders(spark, [{"pay_time": "2024-01-06 00:00:00"}, {"pay_time": "2024-02-01 00:00:00"}, {"pay_time": "2024-03-02 00:00:00"}])
    assert rows_of(pr.period_slice(o, p), "order_id", "period") == [(0, "A"), (0, "B"), (2, "C")]
    assert rows_of(pr.any_period(o, p), "order_id") == [(0,), (2,)]


def test_group_names_are_normalised(spark):
    p = pr.periods_table(spark, {"CM-2": ("2024-01-01", "2024-01-10")})
    o = orders(spark, [{"grp": " cm2 ", "pay_time": "2024-01-02 00:00:00"}, {"grp": "CM3", "pay_time": "2024-01-02 00:00:00"}, {"grp": None}])
    assert rows_of(pr.group_period(o, p), "order_id", "grp") == [(0, "CM-2")]
    assert rows_of(pr.exclude_groups(o, ["Cm 3"]), "order_id") == [(0,), (2,)]


def test_groups_without_orders_keep_zero_rows(spark):
    p = pr.periods_table(spark, {"A": ("2024-01-01", "2024-01-10"), "Z": ("2024-01-01", "2024-01-10")})
    out = co.window_start_summary(edge_orders(spark), p, 3)
    assert rows_of(out, "grp", "pays", "pays_full") == [("A", 1, 2), ("Z", 0, 0)]
    assert {r["grp"]: r["refund_to_pay_pct"] for r in out.collect()}["Z"] is None


def test_refund_needs_earlier_payment(spark):
    p = pr.periods_table(spark, P)
    o = orders(
        spark,
        [
            {"pay_time": "2024-01-02 00:00:00", "refund_time": "2024-01-01 12:00:00"},
            {"pay_time": "2024-01-02 00:00:00", "refund_time": "2024-01-03 00:00:00"},
        ],
    )
    assert co.window_start_summary(o, p, 3).first()["refunds"] == 1
    stats = co.interval_stats(o, p, {"pr": ("pay_time", "refund_time")}).first()
    assert (stats["min"], stats["max"], stats["count"]) == (-1.0, 1.0, 2)


def test_sweep_equals_single_windows(spark):
    p = pr.periods_table(spark, P)
    o = edge_orders(spark)
    sweep = {r["n"]: r for r in co.window_sweep(o, p, [1, 3, 5]).collect()}
    for n in (1, 3, 5):
        start, lock = co.window_start_summary(o, p, n).first(), co.window_lock_summary(o, p, n).first()
        assert (sweep[n]["start_pays"], sweep[n]["start_refunds"]) == (start["pays"], start["refunds"])
        for c in ("locks", "deposits", "deposit_or_pay", "pays_full", "retained_locks", "refunds"):
            assert sweep[n][c] == lock[c], (n, c)


def test_age_bands(spark):
    ages = [None, 0, 24, 25, 35, 54, 55, 100, 150]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    got = {r["age"]: (r["s"], r["ab"], r["seg"], r["l"]) for r in df.select(
        "age", sm.age_band("age", "structure").alias("s"), sm.age_band("age", "ab").alias("ab"),
        sm.age_band("age", "segments").alias("seg"), sm.age_band("age", "lock").alias("l")).collect()}
    assert got[None] == ("unknown", None, None, "unknown")
    assert got[25] == ("25-34", "25-35", "<25", "25-29")
    assert got[55] == ("55+", "55+", "45-55", "55+")
    assert got[100] == ("55+", None, "55+", "55+")
    assert got[0] == ("<25", "<25", None, "<25")


def check_char(body):
    return "10X98765432"[sum(int(c) * w for c, w in zip(body, rules.ID_WEIGHTS)) % 11]


def test_identity_numbers(spark):
    body = "11010519491231002"
    good = body + check_char(body)
    cases = [good, good.lower(), " " + good + " ", body + ("1" if good[-1] != "1" else "2"), body, None, "", "A" * 18]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string")
    got = [r["v"] for r in df.orderBy("k").select(rules.id_valid("c").alias("v")).collect()]
    assert got == [True, True, True, False, False, False, False, False]


def test_classifiers(spark):
    df = spark.createDataFrame([(None,), (" ",), ("X1 52 Max",), ("X1 Max",)], "c string")
    assert [r[0] for r in df.select(rules.product_category("c")).collect()] == ["unknown", "unknown", "range_extender", "battery"]
    df = spark.createDataFrame([("线上FAC",), ("FAC一区",), ("华东",), (None,)], "c string")
    assert [r[0] for r in df.select(rules.region_type("c")).collect()] == ["virtual", "fac", "traditional", "unknown"]
    df = spark.createDataFrame([("男",), (" Female",), ("0",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(rules.normalize_enum("c")).collect()] == ["male", "female", "female", "unknown", "unknown"]
    df = spark.createDataFrame([("ls9 pro",), ("CM2",), ("CM1",), (None,)], "c string")
    assert [r[0] for r in df.select(rules.map_contains("c")).collect()] == [5000.0, 2000.0, None, None]


def test_refund_carry_modes(spark):
    """A refund on a day without orders shows later by default, at once with dense days."""
    p = pr.periods_table(spark, P)
    o = orders(
        spark,
        [
            {"pay_time": "2024-01-01 01:00:00", "refund_time": "2024-01-02 01:00:00"},
            {"pay_time": "2024-01-03 01:00:00"},
            {"pay_time": "2024-01-04 01:00:00", "refund_time": "2024-01-04 09:00:00"},
        ],
    )
    days = cv.period_daily(o, p)
    assert rows_of(cv.cum_refund_rate(days), "day", "cum_refunds") == [(1, 0), (3, 0), (4, 2)]
    assert rows_of(cv.cum_refund_rate(days, dense_days=True), "day", "cum_refunds") == [(1, 0), (2, 1), (3, 1), (4, 2)]


def test_lock_conversion_accumulates_before_the_filter(spark):
    p = pr.periods_table(spark, P)
    o = orders(spark, [{"pay_time": "2024-01-02 00:00:00", "lock_time": x} for x in ("2024-01-05 00:00:00", "2024-01-11 00:00:00", None, None)])
    assert rows_of(cv.lock_conversion_curve(o, p, 5), "day", "cumulative_locks", "conversion_pct") == [(1, 2, 50.0)]


def test_interpolation(spark):
    pts = spark.createDataFrame([("a", 3, 9.0), ("a", 5, 13.0), ("a", 30, 38.0)], "grp string, day int, rate double")
    grid = spark.createDataFrame([("a", x) for x in (1.0, 3.0, 4.0, 10.0, 31.0)], "grp string, day double")
    assert rows_of(cv.interp_grid(pts, grid), "day", "rate") == [(1.0, 9.0), (3.0, 9.0), (4.0, 11.0), (10.0, 18.0), (31.0, 38.0)]
