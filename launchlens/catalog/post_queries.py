"""Queries over posts, growth curves and lag tests, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchlens.catalog.bindings import SQL_EV, event_periods, fact_events, table
from launchlens.catalog.curve_queries import CURVE, PAIRS, pair_series
from launchlens.catalog.registry import query, r
from launchlens.catalog.solve_sql import products, steps
from launchlens.operators import curves as cv
from launchlens.operators import growth as gr
from launchlens.operators import posts as po
from launchlens.operators import series as se

# The provided texts are not Chinese: the same rules with words that occur in them.
RULES = po.PostRules(
    ui_words=("http", "@", "cookie"), indicators=("the", "der", "que", "of"), script="[a-z]", block_words=("the", "que", "der"),
    quality_ui_words=("http", "@"), experience=("and", "und", "les", "los"), sentence_end=".", score_markers=(("src1", 1.0), ("src2", 0.5)),
    times=(r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,3}-\d{1,4}", r"\d+\.\d+"), counters=(("likes", "-"), ("comments", r"\."), ("shares", "@"), ("views", " ")),
)


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), "source")


def any_sql(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


VALID = f"""(length(text) >= 20 AND NOT ({any_sql('text', RULES.ui_words)} AND length(text) < 100) AND NOT regexp_matches(text, '^[\\d\\s\\-\\.\\,\\:：]+$')
AND NOT regexp_matches(text, '^[\\s\\.\\,\\!\\?\\-\\:：；"''（）\\(\\)]+$') AND regexp_matches(text, '[a-z]') AND {any_sql('text', RULES.indicators)})"""


@query("post_valid", f"SELECT doc_id, {VALID} AS valid FROM documents")
def post_valid(spark, sf):
    return documents(spark, sf).select("doc_id", po.post_valid("content", RULES).alias("valid"))


_T = [f"nullif(regexp_extract(text, '{p}'), '')" for p in RULES.times]
_C = {k: f"TRY_CAST(nullif(regexp_extract(text, '(\\d+){w}', 1), '') AS INTEGER)" for k, w in RULES.counters}


@query("post_fields", f"SELECT doc_id, coalesce({', '.join(_T)}, '') AS post_time, " + ", ".join(f"{r(v)} AS {k}" for k, v in _C.items()) + " FROM documents")
def post_fields(spark, sf):
    rows = documents(spark, sf).select("doc_id", po.post_time("content", RULES).alias("post_time"), po.post_counters("content", RULES).alias("m"))
    return rows.select("doc_id", "post_time", *[F.col("m")[k].cast("double").alias(k) for k, _ in RULES.counters])


CLEAN = """
cl0 AS (SELECT *, regexp_replace(trim(regexp_replace({src}, '[\\s\\x0B\\x85\\p{{Z}}]+', ' ', 'g'), ' '), '<[^>]+>', '', 'g') AS c FROM {table}),
cl AS (SELECT *, CASE WHEN length(c) <= 1000 THEN c WHEN regexp_extract(substring(c, 1, 1000), '(?s)^(.*\\.)', 1) <> '' THEN regexp_extract(substring(c, 1, 1000), '(?s)^(.*\\.)', 1)
  ELSE substring(c, 1, 1000) || '...' END AS cleaned FROM cl0)
"""


@query("post_clean", f"WITH {CLEAN.format(src='text', table='documents')} SELECT doc_id, cleaned, length(cleaned) AS n FROM cl")
def post_clean(spark, sf):
    return documents(spark, sf).select("doc_id", po.post_clean("content", RULES).alias("cleaned")).withColumn("n", F.length("cleaned"))


def posts(spark, sf):
    """Documents dressed as posts: name, time, counters and images follow from the id."""
    k = F.col("doc_id")
    counts = F.map_from_arrays(
        F.array(F.lit("likes"), F.lit("comments")), F.array((k % 150).cast("int"), (k % 7).cast("int"))
    )
    return table(spark, sf, "documents").select(
        k.alias("post_id"), F.col("text").alias("content"),
        F.when(k % 3 == 0, "").otherwise(F.col("source")).alias("username"),
        F.when(k % 6 == 1, "").otherwise(F.concat(F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd"), F.lit(" 10:00"))).alias("timestamp"),
        F.when(k % 4 != 0, counts).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))).alias("interactions"),
        F.when(k % 5 == 0, F.array(F.lit("a.jpg"))).otherwise(F.array().cast("array<string>")).alias("images"),
        F.when(k % 9 == 0, "json_data").otherwise("html").alias("source"),
        F.length("text").alias("content_length"),
    )


POSTS = """
po AS (SELECT doc_id AS post_id, text AS content, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS username,
  CASE WHEN doc_id % 6 = 1 THEN '' ELSE strftime(DATE '2025-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d') || ' 10:00' END AS timestamp,
  doc_id % 4 <> 0 AS has_inter, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 150 + doc_id % 7 ELSE 0 END AS inter, doc_id % 5 = 0 AS has_img,
  CASE WHEN doc_id % 9 = 0 THEN 'json_data' ELSE 'html' END AS source, length(text) AS content_length FROM documents)
"""
SCORE = """(1.0 + CASE WHEN username <> '' THEN 2 ELSE 0 END + CASE WHEN contains(username, 'src1') THEN 1 ELSE 0 END + CASE WHEN contains(username, 'src2') THEN 0.5 ELSE 0 END
+ CASE WHEN timestamp <> '' THEN 1 ELSE 0 END + CASE WHEN has_inter THEN 2 + CASE WHEN inter > 10 THEN 1 ELSE 0 END + CASE WHEN inter > 100 THEN 1 ELSE 0 END ELSE 0 END
+ CASE WHEN content_length BETWEEN 100 AND 800 THEN 1 WHEN content_length > 800 THEN 0.5 ELSE 0 END + CASE WHEN has_img THEN 0.5 ELSE 0 END)"""
QUALITY = f"""(timestamp <> '' AND (source = 'json_data' OR length(username) >= 2) AND length(content) BETWEEN 50 AND 2000
AND NOT ({any_sql('content', RULES.quality_ui_words)} AND length(content) < 200) AND {any_sql('content', RULES.experience)})"""


@query("post_score", f"WITH {POSTS} SELECT post_id, {r(SCORE)} AS score, rank() OVER (ORDER BY CAST({SCORE} AS DOUBLE) DESC) AS rank FROM po")
def post_score(spark, sf):
    # ranks of a few score levels: counts per score, then their running total
    scored = posts(spark, sf).select("post_id", po.post_score(RULES).alias("score"))
    from pyspark.sql import Window

    levels = scored.groupBy("score").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return scored.join(levels.select("score", (above + 1).alias("rank")), "score").select("post_id", "score", "rank")


@query("post_quality_filter", f"WITH {POSTS} SELECT post_id FROM po WHERE {QUALITY}")
def post_quality_filter(spark, sf):
    return po.post_quality_filter(posts(spark, sf), RULES).select("post_id")


@query("dedupe_prefix", f"WITH {POSTS} SELECT post_id, content_length FROM po QUALIFY row_number() OVER (PARTITION BY substring(content, 1, 100) ORDER BY content_length DESC, post_id) = 1")
def dedupe_prefix(spark, sf):
    return po.dedupe_prefix(posts(spark, sf)).select("post_id", "content_length")


@query("post_summary", f"""WITH {POSTS}, k AS (SELECT *, {SCORE} AS score FROM po WHERE {QUALITY}), {CLEAN.format(src='content', table='k')}
SELECT count(*) AS posts, CAST(sum(length(cleaned)) AS BIGINT) AS total_length, {r('avg(length(cleaned))')} AS mean_length, {r('avg(score)')} AS mean_score, count(*) FILTER (username <> '') AS with_username,
count(*) FILTER (timestamp <> '') AS with_timestamp, count(*) FILTER (has_img) AS with_images, count(*) FILTER (has_inter) AS with_interactions, (SELECT count(*) FROM po) AS raw_posts,
{r('((SELECT count(*) FROM po) - count(*)) / (SELECT count(*) FROM po) * 100')} AS filtered_pct FROM cl""")
def post_summary(spark, sf):
    raw = posts(spark, sf)
    return po.post_summary(raw, po.format_posts(raw, RULES))


@query("posts_in_range", f"WITH {POSTS} SELECT post_id, timestamp FROM po WHERE timestamp <> '' AND substring(timestamp, 1, 10) BETWEEN '2025-02-01' AND '2025-05-31'")
def posts_in_range(spark, sf):
    return po.posts_in_range(posts(spark, sf), "2025-02-01", "2025-05-31").select("post_id", "timestamp")


@query("post_range", f"""WITH {POSTS} SELECT min(substring(timestamp, 1, 10)) FILTER (timestamp <> '') AS first, max(substring(timestamp, 1, 10)) FILTER (timestamp <> '') AS last, count(*) AS posts FROM po""")
def post_range(spark, sf):
    return po.post_range(posts(spark, sf))


@query("crawl_stats", f"""SELECT count(*) AS pages, count(*) FILTER (contains(html, '<article')) AS ok, count(*) FILTER (NOT contains(html, '<article')) AS failed,
CAST(sum(len(string_split(html, '<p>')) - 1) AS BIGINT) AS posts, {r("count(*) FILTER (contains(html, '<article')) / count(*) * 100")} AS success_pct FROM pages""")
def crawl_stats(spark, sf):
    return po.crawl_stats(table(spark, sf, "pages"), F.col("html").contains("<article"), F.size(F.split("html", "<p>")) - 1)


@query("post_batches", """WITH n AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
b AS (SELECT conv_id, CAST((pos - 1) // 3 AS BIGINT) AS batch, pos, CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '...' ELSE text END AS t FROM n)
SELECT conv_id, batch, count(*) AS posts, string_agg(pos || ': ' || t, chr(10) ORDER BY pos) AS preview FROM b GROUP BY conv_id, batch""")
def post_batches(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("content"))
    return po.post_batches(c, [F.col("turn")], F.floor(F.col("turn") / 1000), ["conv_id"], 3, 40)


@query("post_batches_whole", """WITH n AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS pos FROM documents)
SELECT CAST((pos - 1) // 10 AS BIGINT) AS batch, count(*) AS posts, string_agg(pos || ': ' || CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END, chr(10) ORDER BY pos) AS preview FROM n GROUP BY 1""")
def post_batches_whole(spark, sf):
    return po.post_batches(documents(spark, sf), [F.col("doc_id")], F.floor(F.col("doc_id") / 4096))


@query("posts_from_pages")
def posts_from_pages(spark, sf):
    out = po.posts_from_pages(table(spark, sf, "pages"), RULES)
    return out.withColumn("interactions", F.to_json("interactions")).withColumn("images", F.to_json("images"))


# ---- growth


def curve(spark, sf):
    return cv.daily_curve(fact_events(spark, sf, "grp", "pay_time"), event_periods(spark))


@query("growth_phases", f"""WITH {SQL_EV}, {CURVE}, x AS (SELECT *, day / max(day) OVER (PARTITION BY grp) AS q FROM dc)
SELECT grp, day, CASE WHEN q <= 0.107 THEN 'initial_surge' WHEN q BETWEEN 0.179 AND 0.750 THEN 'plateau' ELSE 'final_surge' END AS phase FROM x""")
def growth_phases(spark, sf):
    return gr.growth_phases(curve(spark, sf))


@query("growth_tail", f"""WITH {SQL_EV}, {CURVE}, x AS (SELECT *, max(day) OVER (PARTITION BY grp) AS m FROM dc), y AS (SELECT grp, day, cum - lag(cum) OVER w AS g FROM x WHERE day >= floor(m * 0.5) WINDOW w AS (PARTITION BY grp ORDER BY day)),
z AS (SELECT *, g - lag(g) OVER (PARTITION BY grp ORDER BY day) AS a FROM y) SELECT grp, count(*) AS days, {r('avg(g)')} AS avg_daily_growth, {r('avg(a)')} AS growth_acceleration, CAST(max(g) AS BIGINT) AS max_daily_growth FROM z GROUP BY 1 HAVING count(*) > 2""")
def growth_tail(spark, sf):
    return gr.growth_tail(curve(spark, sf))


@query("growth_fit")
def growth_fit(spark, sf):
    return gr.growth_fit(curve(spark, sf))


def poly_sql() -> str:
    """Quadratic of the plateau and cubic of the final phase by their normal equations."""
    parts, ctes = [], []
    for model, degree, inside in (("plateau", 2, "day >= floor(q * 0.179) AND day <= floor(q * 0.714)"), ("final", 3, "day >= floor(q * 0.714)")):
        xs = [f"x{k}" for k in range(1, degree + 1)]
        ctes.append(f"d_{model} AS (SELECT grp, {', '.join(f'pow(day, {k}) AS x{k}' for k in range(1, degree + 1))}, CAST(cum AS DOUBLE) AS y FROM dq WHERE {inside})")
        means = ", ".join(f"avg({x}) AS m{x}" for x in xs)
        ctes.append(f"s_{model} AS (SELECT grp, count(*) AS n, avg(y) AS my, {means}, {products([*xs, 'y'])} AS m FROM d_{model} GROUP BY 1 HAVING count(*) > {degree})")
        ctes.append(steps(f"g_{model}", f"s_{model}", "grp", degree))
        c = [f"g.m[{k}][{degree + 1}]" for k in range(1, degree + 1)]
        c0 = "my - (" + " + ".join(f"{c[k]} * mx{k + 1}" for k in range(degree)) + ")"
        coefs = [c0, *c, *["0"] * (3 - degree)]
        parts.append(f"SELECT grp, '{model}' AS model, n AS points, {', '.join(f'{r(e)} AS c{k}' for k, e in enumerate(coefs))}, {r(f'sqrt(greatest(g.m[{degree + 1}][{degree + 1}], 0) / n)')} AS rmse FROM g_{model} g JOIN s_{model} USING (grp) WHERE k = {degree + 1}")
    return f"WITH RECURSIVE {SQL_EV}, {CURVE}, dq AS (SELECT *, max(day) OVER (PARTITION BY grp) AS q FROM dc), {', '.join(ctes)} {' UNION ALL '.join(parts)}"


@query("growth_poly", poly_sql())
def growth_poly(spark, sf):
    fits = gr.growth_fit(curve(spark, sf))
    return fits.where("(model = 'plateau' and points > 2) or (model = 'final' and points > 3)")


@query("growth_forecast")
def growth_forecast(spark, sf):
    c = curve(spark, sf)
    return gr.growth_forecast(c, gr.growth_fit(c), 15)


# ---- lag tests


def lag_series(spark, sf):
    return pair_series(spark, sf).select("grp", "date", F.col("pays").alias("x"), F.col("locks").alias("y"))


@query("granger")
def granger(spark, sf):
    return se.granger(lag_series(spark, sf), 7)


def granger_sql(max_lag: int = 3) -> str:
    """F statistics of the first lags: one elimination per lag, own lags first."""
    ctes, parts = [], []
    for k in range(1, max_lag + 1):
        cols = [*(f"y{j}" for j in range(1, k + 1)), *(f"x{j}" for j in range(1, k + 1))]
        lags = ", ".join(f"lag({c[0]}, {c[1:]}) OVER w AS {c}" for c in cols)
        ctes.append(f"l{k} AS (SELECT * FROM (SELECT grp, y, row_number() OVER w AS t, {lags} FROM sx WINDOW w AS (PARTITION BY grp ORDER BY dt)) WHERE t > {k})")
        ctes.append(f"a{k} AS (SELECT grp, count(*) AS n, {products([*cols, 'y'])} AS m FROM l{k} GROUP BY 1)")
        ctes.append(steps(f"g{k}", f"a{k}", "grp", 2 * k))
        end = f"m[{2 * k + 1}][{2 * k + 1}]"
        dof = f"(a{k}.n - {2 * k + 1})"
        f = f"CASE WHEN {dof} > 0 AND e.{end} > 1e-12 * greatest(e.o[{2 * k + 1}][{2 * k + 1}], 1) THEN greatest(o.{end} - e.{end}, 0) / e.{end} / {k} * {dof} END"
        parts.append(f"""SELECT d.grp, CAST({k} AS BIGINT) AS lag, CAST(greatest(d.days - {k}, 0) AS BIGINT) AS n, {r(f)} AS f_stat FROM (SELECT grp, count(*) AS days FROM sx GROUP BY 1) d
  LEFT JOIN a{k} ON a{k}.grp = d.grp LEFT JOIN g{k} o ON o.grp = d.grp AND o.k = {k + 1} LEFT JOIN g{k} e ON e.grp = d.grp AND e.k = {2 * k + 1}""")
    return f"WITH RECURSIVE {SQL_EV}, {PAIRS}, sx AS (SELECT grp, dt, CAST(pays AS DOUBLE) AS x, CAST(locks AS DOUBLE) AS y FROM dp WHERE pays <> 0 OR locks <> 0), {', '.join(ctes)} {' UNION ALL '.join(parts)}"


@query("granger_stats", granger_sql())
def granger_stats(spark, sf):
    return se.granger(lag_series(spark, sf), 3).select("grp", "lag", "n", "f_stat")


def _unit_root_sql(col: str) -> str:
    return f"""SELECT grp, '{col}' AS series, {r('b / sqrt((syy - b * sxy) / (n - 2) / sxx)')} AS stat, CAST(0 AS BIGINT) AS lags FROM (
  SELECT grp, count(*) AS n, regr_sxx(d, v) AS sxx, regr_sxy(d, v) AS sxy, regr_syy(d, v) AS syy, regr_slope(d, v) AS b
  FROM (SELECT grp, {col} - lag({col}) OVER w AS d, lag({col}) OVER w AS v FROM sx WINDOW w AS (PARTITION BY grp ORDER BY dt)) WHERE d IS NOT NULL GROUP BY 1)"""


@query("adf_lag0", f"WITH {SQL_EV}, {PAIRS}, sx AS (SELECT grp, dt, CAST(pays AS DOUBLE) AS x, CAST(locks AS DOUBLE) AS y FROM dp) {_unit_root_sql('x')} UNION ALL {_unit_root_sql('y')}")
def adf_lag0(spark, sf):
    return se.adf(lag_series(spark, sf), lags=0).select("grp", "series", "stat", "lags")


@query("best_lag")
def best_lag(spark, sf):
    return se.best_lag(se.granger(lag_series(spark, sf), 7))


@query("adf")
def adf(spark, sf):
    return se.adf(lag_series(spark, sf))
