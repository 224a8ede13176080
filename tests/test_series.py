"""Lag tests, growth fits, posts and sources against closed forms and hand-made documents."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from launchlens.operators import growth as gr, posts as po, series as se
from launchlens.sources import readers as rd


def test_tail_probabilities():
    for f, d1, d2 in ((4.0, 1, 10), (2.5, 3, 20), (0.3, 5, 7), (40.0, 2, 30)):
        u = np.linspace(0, 1, 400_001)[1:-1]  # x = f + u / (1 - u) maps the tail to (0, 1)
        x = f + u / (1 - u)
        log_c = math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2) + d1 / 2 * math.log(d1 / d2)
        pdf = np.exp(log_c + (d1 / 2 - 1) * np.log(x) - (d1 + d2) / 2 * np.log1p(d1 * x / d2))
        area = np.sum(pdf / (1 - u) ** 2) * (u[1] - u[0])
        assert abs(se.f_tail(f, d1, d2) - area) < 1e-4 * max(area, 1e-6) + 1e-6
    assert abs(se.chi2_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(se.chi2_tail(2.0, 2) - math.exp(-1)) < 1e-12
    assert abs(se.chi2_tail(30.0, 4) - 4.894437128029217e-06) < 1e-12


def test_granger_direction(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    y = np.concatenate([[0.0], 0.8 * x[:-1]]) + rng.normal(scale=0.3, size=200)
    rows = [(g, k, float(a), float(b)) for g, (u, v) in {"xy": (x, y), "yx": (y, x)}.items() for k, (a, b) in enumerate(zip(u, v))]
    df = spark.createDataFrame(rows, "grp string, date int, x double, y double")
    out = {(r["grp"], r["lag"]): r for r in se.granger(df, 3, drop_joint_zeros=False).collect()}
    assert out[("xy", 1)]["p_f"] < 1e-20 and out[("yx", 1)]["p_f"] > 0.01
    assert {r["grp"]: r["lag"] for r in se.best_lag(se.granger(df, 3)).collect()}["xy"] in (1, 2, 3)


def test_granger_short_series_is_null(spark):
    df = spark.createDataFrame([("a", k, float(k % 2), float(k % 3)) for k in range(5)], "grp string, date int, x double, y double")
    assert [(r["lag"], r["f_stat"] is None) for r in se.granger(df, 3).orderBy("lag").collect()][1:] == [(2, True), (3, True)]


def test_unit_root():
    rng = np.random.default_rng(1)
    noise, walk = rng.normal(size=300), np.cumsum(rng.normal(size=300))
    assert se.unit_root(noise)[1] < 0.01 < 0.05 < se.unit_root(walk)[1]
    assert se.unit_root(np.ones(50)) == (None, None, None)
    assert abs(se.unit_root_p(-2.86) - 0.05) < 0.002 and abs(se.unit_root_p(-3.43) - 0.01) < 0.001


# A presale's daily and running orders used as a growth fixture.
CURVE_A = [2165, 3254, 4190, 4763, 5265, 5728, 6161, 6642, 7507, 8462, 8908, 9292, 9662, 10034, 10399, 10930, 11651, 12272, 13002, 13475, 14003, 14603, 15767, 17098, 18267, 19770, 22770, 26937]


@pytest.fixture(scope="module")
def curve(spark):
    rows = [("A", k + 1, int(v - (CURVE_A[k - 1] if k else 0)), v) for k, v in enumerate(CURVE_A)]
    x = np.arange(1, 31)
    s = gr.s_curve(x, np.array([1000.0, 0.3, 21.0, 20.0]))
    rows += [("S", int(k), 0, int(round(v * 1000))) for k, v in zip(x, s)]
    return spark.createDataFrame(rows, "grp string, day int, daily_orders int, cumulative_orders int")


def test_phases(curve):
    got = {r["day"]: r["phase"] for r in gr.growth_phases(curve).where("grp = 'A'").collect()}
    assert [got[k] for k in (1, 2, 3, 4, 5, 6, 21, 22)] == ["initial_surge"] * 2 + ["final_surge"] * 3 + ["plateau"] * 2 + ["final_surge"]


def test_tail(curve):
    row = gr.growth_tail(curve).where("grp = 'A'").first()
    tail = np.diff(CURVE_A[13:])
    assert (row["days"], row["max_daily_growth"]) == (15, tail.max())
    assert abs(row["avg_daily_growth"] - tail.mean()) < 1e-9 and abs(row["growth_acceleration"] - np.diff(tail).mean()) < 1e-9


def test_fits(curve):
    fits = {(r["grp"], r["model"]): r for r in gr.growth_fit(curve).collect()}
    y = np.array(CURVE_A, float)[4:19]
    assert fits[("A", "plateau")]["points"] == 15
    want = np.polyfit(np.arange(5, 20), y, 2)[::-1]
    assert np.allclose([fits[("A", "plateau")][f"c{k}"] for k in range(3)], want)
    s = fits[("S", "s_curve")]
    assert s["rmse"] < 2000 and abs(s["c1"] - 0.3) < 0.05 and abs(s["c2"] - 21) < 1.5


def test_forecast(curve):
    out = gr.growth_forecast(curve.where("grp = 'A'"), gr.growth_fit(curve), 35).orderBy("day").collect()
    assert [r["day"] for r in out] == list(range(29, 36))
    assert all(r["cumulative_orders"] >= CURVE_A[-1] for r in out)
    pace, share = np.mean([600, 1164, 1331, 1169, 1503, 3000, 4167][-6:]), 35 / 35
    factor = 2.0 + (share - 0.929) * 12 * (1 + 7 * 0.1)
    assert abs(out[-1]["cumulative_orders"] - (CURVE_A[-1] + pace * 7 * factor * 1.2 * (1 + 7 * 0.05))) < 1e-6
    assert abs(sum(r["daily_orders"] for r in out) - out[-1]["growth"]) < 1e-6
    assert gr.growth_forecast(curve.where("grp = 'A'"), gr.growth_fit(curve), 20).count() == 0


TEXT = "我觉得这款车的驾驶体验非常不错，续航和空间都让人满意，推荐大家去试驾看看。"


def page(body):
    return f"<html><body><script>var a = {{}};</script>{body}</body></html>"


def test_posts_from_html(spark):
    html = page(
        f'<div class="post-card"><span class="user-name">老王</span><p>{TEXT}</p><i>2025-03-04 12点赞 3评论</i><img src="a.jpg"><img src="data:x"></div>'
        '<p>登录 注册 首页</p><p>12345</p>'
    )
    rows = po.posts_from_pages(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["content"], r["username"], r["timestamp"], r["interactions"], r["images"], r["source"]) == (TEXT, "老王", "2025-03-04", {"likes": 12, "comments": 3}, ["a.jpg"], "html")


def test_posts_from_json(spark):
    items = [{"content": TEXT + str(k), "profile_info": {"name": "u"}, "display_time": 1700000000000, "digg_count": k, "comment_count": 1, "image_urls": [{"url": "i.png"}]} for k in range(6)]
    items.append({"content": "short"})
    html = page(f'<script id="d">{json.dumps({"props": {"pageProps": {"cheyouList": {"cheyou_list": items}}}}, ensure_ascii=False)}</script><div class="post"><p>{TEXT}标签页</p></div>')
    rows = po.posts_from_pages(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert {r["source"] for r in rows} == {"json_data"} and len(rows) == 6
    assert {r["timestamp"] for r in rows} == {"2023-11-14 22:13"} and rows[0]["images"] == ["i.png"]


def test_posts_from_broken_json(spark):
    text = f'x = "content": "{TEXT}", "digg_count": 4, "comment_count": 0, "profile_info": {{"name": "w"}}, "display_time": 1700000000'
    out = po.json_posts(spark.createDataFrame([(1, f"<script>{text}</script>")], "page_id long, html string")).collect()
    assert [(r["source"], r["username"], r["interactions"], r["timestamp"]) for r in out] == [("partial_json", "w", {"likes": 4}, "2023-11-14 22:13")]


def test_loose_json_only_while_a_page_has_no_post(spark):
    good = json.dumps({"cheyou_list": [{"content": TEXT + str(k), "display_time": 1700000000} for k in range(6)]}, ensure_ascii=False)
    loose = f'"content": "{TEXT}", "display_time": 1700000000 '
    pages = [
        (1, f"<script>{good}</script><script>x = {loose}</script>"),
        (2, f"<script>{loose}</script><script>y = {loose}{loose}</script>"),
        (3, f"<script>{loose}</script><script>{good}</script>"),
        (4, None),
    ]
    out = po.json_posts(spark.createDataFrame(pages, "page_id long, html string")).groupBy("page_id", "source").count().collect()
    assert {tuple(r) for r in out} == {(1, "json_data", 6), (2, "partial_json", 1), (3, "partial_json", 1), (3, "json_data", 6)}


def test_csv_encoding_is_chosen_from_all_lines_of_each_file(spark, tmp_path):
    lines = "".join(f"n{k},{k}\n" for k in range(2500))
    (tmp_path / "a.csv").write_bytes(("名,数\n" + lines + "智己,9\n").encode("gb18030"))
    (tmp_path / "b.csv").write_text("名,数\n智界,7\n", encoding="utf-8")
    df = rd.scan_csv(spark, str(tmp_path / "*.csv"), latest=False)
    assert df.count() == 2502 and {r[0] for r in df.where("`数` in (7, 9)").collect()} == {"智己", "智界", "n7", "n9"}


def test_post_rules(spark):
    cases = {TEXT: True, "我": False, "登录后查看更多评论内容和分享给朋友我觉得": False, "1" * 30: False, "a" * 40: False, "。！" * 20: False, None: False}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r["c"]: r["v"] for r in df.select("c", po.post_valid("c").alias("v")).collect()} == cases


def test_post_clean(spark):
    long = "好" * 600 + "。" + "的" * 600 + "。"
    df = spark.createDataFrame([("  a \n b<br>c ",), (long,), ("好" * 1200,)], "c string")
    got = [r[0] for r in df.select(po.post_clean("c")).collect()]
    assert got == ["a bc", "好" * 600 + "。", "好" * 1000 + "..."]


def test_post_score(spark):
    rows = [("车主 车龄2年", "2025-01-01", {"likes": 90, "comments": 20}, ["x"], 300), ("", "", {}, [], 50), ("u", "t", {"likes": 11}, [], 900)]
    df = spark.createDataFrame(rows, "username string, timestamp string, interactions map<string,int>, images array<string>, content_length int")
    assert [r[0] for r in df.select(po.post_score()).collect()] == [1 + 2 + 1 + 0.5 + 1 + 4 + 1 + 0.5, 1.0, 1 + 2 + 1 + 3 + 0.5]


def test_registry(spark, tmp_path):
    doc = {"data": [
        {"Member Name": " Ann ", "Member Code": "7", "Id Card": "x", "Dealer Name Fc": "old"},
        {"Member Name": "Ann", "Member Code": "7", "Id Card": "x", "Dealer Name Fc": "new"},
        {"Member Name": "Bob", "Member Code": "", "Id Card": "y"}, {"Member Name": "Cid", "Id Card": "z"},
    ]}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1), encoding="utf-8")
    got = [(r["agent_name"], r["dealer"]) for r in rd.scan_registry(spark, str(tmp_path / "r.json")).collect()]
    assert got == [("Ann", "new")]


def test_definition(spark, tmp_path):
    doc = {"time_periods": {"A": {"start": "2024-01-01", "end": "2024-01-10"}, "B": {"start": "bad", "end": "2024-01-10"}},
           "battery_types": {"x": ["p", " q "], "y": ["r"]}, "vehicle_prices": {"p": 5, "q": 0}}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(doc, indent=2), encoding="utf-8")
    assert [(r["grp"], str(r["start_date"])) for r in rd.load_periods(spark, str(path)).collect()] == [("A", "2024-01-01")]
    assert sorted(tuple(r) for r in rd.load_attr_map(spark, str(path), "battery_types").select("product", "attr").collect()) == [("p", "x"), ("q", "x"), ("r", "y")]
    assert sorted(tuple(r) for r in rd.load_attr_map(spark, str(path), "vehicle_prices").collect()) == [("p", 5), ("q", 0)]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gb18030"])
def test_csv_encodings(spark, tmp_path, encoding):
    (tmp_path / "old.csv").write_text("订单,价格\n旧,1\n", encoding="utf-8")
    import os

    os.utime(tmp_path / "old.csv", (1, 1))
    (tmp_path / "new.csv").write_text("订单,价格\n智己,2\n", encoding=encoding)
    df = rd.scan_csv(spark, str(tmp_path / "*.csv"))
    assert df.columns == ["订单", "价格"] and [tuple(r) for r in df.collect()] == [("智己", "2")]


def test_orders_with_drifted_schema(spark, tmp_path):
    raw = spark.createDataFrame([("1", "2024-01-01 10:00:00", "bad"), ("2", None, "2024-01-02")], "` Order Number ` string, Pay string, `Lock_Time` string")
    raw.write.parquet(str(tmp_path / "o"))
    names = {"Order Number": "order_id", "Pay": "pay_time", "Lock_Time": "lock_time", "Absent": "touch_time"}
    df = rd.scan_orders(spark, str(tmp_path / "o"), names, ["pay_time", "lock_time", "touch_time"])
    got = {r["order_id"]: (str(r["pay_time"]), str(r["lock_time"])) for r in df.collect()}
    assert got == {"1": ("2024-01-01 10:00:00", "None"), "2": ("None", "2024-01-02 00:00:00")}


def test_write_table_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], {"k": 2})], "x int, l array<string>, m map<string,int>")
    for fmt in ("csv", "json", "parquet"):
        rd.write_table(df, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()["l"] == '["a"]'
    assert spark.read.json(str(tmp_path / "json")).first()["x"] == 1
    with pytest.raises(ValueError):
        rd.write_table(df, str(tmp_path / "x"), "xml")
