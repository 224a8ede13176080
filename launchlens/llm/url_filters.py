"""URL verdicts from path rules and from trust and distrust spread over links between hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from launchlens.session import cut_lineage

#: (verdict, host, path): a rule fits its host and all subdomains when the path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits; of equally long ones the first by text."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from one host to another in the html of pages; links within a host say nothing about others.

    Links are counted per (src, dst) with a map-side combine, so a host with a third of
    the pages sends a few rows per task.
    """
    url = F.expr(r"""explode(regexp_extract_all(html, '(?i)href\\s*=\\s*["\']([^"\']*)["\']', 1))""")
    links = pages.select(url_host(F.col("url")).alias("src"), url.alias("link"))
    absolute = F.regexp_like("link", F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://"))
    bare = F.startswith("link", F.lit("//"))
    other = F.regexp_like("link", F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:"))
    dst = F.when(absolute, url_host(F.col("link"))).when(bare, url_host(F.concat(F.lit("http:"), "link"))).when(other, F.lit("")).otherwise(F.col("src"))
    return links.withColumn("dst", dst).where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank.

    `hosts` has the teleport weights `trusted` and `blocked` of every seed host, each in
    0..1. Trust follows links forward, distrust follows them backwards, to those that link to
    blocked hosts; both walk in the same join. A walk that meets a host without links
    ends. A score counts the visits of walks that start on each seed with its weight, which is the PageRank
    divided by 1 - damping, so a host's seed weight alone gives that score, whatever the number of hosts. After
    `rounds` steps what is left of the walks is below damping ** rounds.
    """
    forward = edges.select("src", "dst", "n", F.lit(0).alias("kind"))
    backward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit(1).alias("kind"))
    both = forward.union(backward)
    out = both.groupBy("src", "kind").agg(F.sum("n").alias("total"))
    steps = cut_lineage(both.join(out, ["src", "kind"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("w")))
    seeds = cut_lineage(
        hosts.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trusted").alias("s")), F.struct(F.lit(1).alias("kind"), F.col("blocked").alias("s")))).alias("x"))
        .select("host", "x.*")
        .where("s > 0")
        .select("kind", "host", F.col("s").alias("x"))
    )
    rank = seeds
    for k in range(rounds):
        moved = steps.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("x") * F.col("w") * damping).alias("x"))
        rank = moved.union(seeds).groupBy("kind", "host").agg(F.sum("x").alias("x"))
        if k % 4 == 3 or k == rounds - 1:
            rank = cut_lineage(rank)
    return rank.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("x"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("x"))), F.lit(0.0)).alias("distrust"),
    )


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, damping: float = 0.85, rounds: int = 20, threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A rule decides the pages it fits. For the rest, the share of a host's pages that rules
    allow (block) makes it a trusted (blocked) seed, both spread over links between
    hosts, and a host is blocked when its distrust exceeds its trust by `threshold` or more.

    Null urls and urls without `://` have an empty host and path, fit no rule and are
    allowed; null html has no links; repeated pages give repeated rows and
    count as often; an empty table gives no rows. Only page_id, url and html are read.
    """
    p = pages.select("page_id", "url", "html")
    judged = p.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = judged.withColumn("_r", rule_column(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.when(F.col("_r.verdict") == v, 1.0).otherwise(0.0))
    hosts = judged.where("host != ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    scores = propagate(hosts, host_edges(p), damping, rounds)
    joined = judged.join(scores, "host", "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    spread = F.when(distrust - trust >= threshold, "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), spread).alias("verdict"), F.round(trust, 6).alias("trust"), F.round(distrust, 6).alias("distrust")
    )


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, damping: float = 0.85, rounds: int = 20, threshold: float = 0.5) -> str:
    """The same in DuckDB SQL; the rounds are written out."""
    host = lambda u: f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    path = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    fits = [(f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))", h + p, v) for v, h, p in ordered]
    case = lambda k: "case " + " ".join(f"when {f[0]} then '{f[k]}'" for f in fits) + " end"
    walk = ["r0 as materialized (select kind, host, s as x from seeds)"]
    for k in range(rounds):
        walk.append(
            f"r{k + 1} as materialized (select kind, host, sum(x) as x from (select s.kind, s.dst as host, r.x * s.w * {damping} as x from steps s join r{k} r on r.kind = s.kind and r.host = s.src "
            "union all select kind, host, s from seeds) group by 1, 2)"
        )
    return f"""
with p as materialized (select page_id, url, html, {host('url')} as host, {path} as path from pages),
j as materialized (select page_id, host, path, {case(1)} as rule, {case(2)} as verdict from p),
links as (select host as src, unnest(regexp_extract_all(html, 'href\\s*=\\s*["'']([^"'']*)["'']', 1, 'i')) as link from p),
ends as (select src, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then {host('link')} when starts_with(link, '//') then {host("('http:' || link)")}
  when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then '' else src end as dst from links),
edges as materialized (select src, dst, count(*) as n from ends where src != '' and dst != '' and src != dst group by 1, 2),
two as (select 0 as kind, src, dst, n from edges union all select 1, dst, src, n from edges),
steps as materialized (select kind, src, dst, n * 1.0::double / sum(n) over (partition by kind, src) as w from two),
hosts as (select host, avg(case when verdict = 'allow' then 1.0 else 0.0 end) as t, avg(case when verdict = 'block' then 1.0 else 0.0 end) as b from j where host != '' group by 1),
seeds as materialized (select 0 as kind, host, t::double as s from hosts where t > 0 union all select 1, host, b::double from hosts where b > 0),
{", ".join(walk)},
scores as (select host, sum(case when kind = 0 then x else 0 end) as trust, sum(case when kind = 1 then x else 0 end) as distrust from r{rounds} group by 1)
select page_id, host, path, rule, coalesce(verdict, case when coalesce(distrust, 0) - coalesce(trust, 0) >= {threshold} then 'block' else 'allow' end) as verdict,
  round(coalesce(trust, 0.0), 6) as trust, round(coalesce(distrust, 0.0), 6) as distrust
from j left join scores using (host)"""
