from launchlens.llm import url_filters as U

RULES = (("allow", "good.example", "/"), ("block", "bad.example", "/"))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, n long")


def page(k, host, *links):
    return (k, f"https://{host}/p{k}", "".join(f'<a href="{u}">x</a>' for u in links), "clash", 1)


def test_host_and_path(spark):
    urls = ["HTTP://A.Example/Pa?q#f", "x://h", "no scheme", None, "", "a://b#/c", "s://u@H.x:80/é?", "p/://q/r"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [tuple(r) for r in df.select(U.url_host(df.url), U.url_path(df.url)).collect()]
    assert got == [("a.example", "/Pa"), ("h", ""), ("", ""), ("", ""), ("", ""), ("b", ""), ("u@h.x:80", "/é"), ("q", "/r")]


def test_longest_rule_and_subdomains(spark):
    rows = [(1, "http://x.example.net/en/1"), (2, "http://example.net/en"), (3, "http://notexample.net/en/1"), (4, "http://example.com/de/"), (5, "http://org/fr/2"), (6, "http://a.org/de/2")]
    got = {r.page_id: (r.rule, r.verdict) for r in U.url_filter(pages(spark, [(k, u, None, None, None) for k, u in rows])).collect()}
    assert got[1] == ("example.net/en/", "allow")
    assert got[2] == ("net/", "block") and got[3] == ("net/", "block")
    assert got[4] == ("example.com/de/", "block") and got[5] == ("org/fr/", "allow") and got[6] == (None, "allow")


def test_distrust_runs_against_links_and_trust_along_them(spark):
    rows = [
        page(1, "good.example", "https://friend.example/x"),
        page(2, "bad.example", "https://victim.example/"),
        page(3, "farm.example", "https://bad.example/a", "//bad.example/b"),
        page(4, "victim.example", "/home"),
        page(5, "friend.example", "mailto:a@bad.example", "javascript:0"),
    ]
    got = {r.host: r for r in U.url_filter(pages(spark, rows), RULES).collect()}
    assert got["farm.example"].verdict == "block" and got["farm.example"].distrust > 0.5
    assert got["victim.example"].verdict == "allow" and got["victim.example"].distrust == 0
    assert got["friend.example"].trust > 0.1 and got["friend.example"].verdict == "allow"


def test_propagation_against_a_plain_loop(spark):
    hosts = ["a", "b", "c", "d"]
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("c", "c", 3), ("d", "a", 5)]
    seeds = {"a": 1.0, "d": 0.25}
    df = U.propagate(
        spark.createDataFrame([(h, seeds.get(h, 0.0), 1.0 if h == "c" else 0.0) for h in hosts], "host string, trusted double, blocked double"),
        spark.createDataFrame(edges, "src string, dst string, n long"),
        rounds=12,
    )
    got = {r.host: (r.trust, r.distrust) for r in df.collect()}

    def walk(seed, links):
        x = dict(seed)
        total = {}
        for s, _, n in links:
            total[s] = total.get(s, 0) + n
        for _ in range(12):
            y = dict(seed)
            for s, t, n in links:
                if s in x:
                    y[t] = y.get(t, 0) + 0.85 * x[s] * n / total[s]
            x = y
        return x

    trust, distrust = walk(seeds, edges), walk({"c": 1.0}, [(b, a, n) for a, b, n in edges])
    for h in hosts:
        assert abs(got[h][0] - trust.get(h, 0)) < 1e-9 and abs(got[h][1] - distrust.get(h, 0)) < 1e-9


def test_edge_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "", None, None), (1, "", "", None, None), (2, "http://a/", "<a href=''>" * 5000, None, None)]
    got = U.url_filter(pages(spark, rows)).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"}
    assert U.url_filter(pages(spark, [])).collect() == []
