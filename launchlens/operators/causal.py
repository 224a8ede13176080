"""Propensity matching, balance and treatment effect."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from launchlens.operators.logistic import Many, Member, fit, group_moments, keyed_scores, prepare
from launchlens.operators.models import FeatureSpec
from launchlens.plans.selection import digit
from launchlens.plans.skew import ordinal, with_row
from launchlens.session import cut_lineage

# Widths of the score cells tried inside the caliper, finest first.
CELL_SHARES = (1 / 64, 1 / 8, 1)


@dataclass(frozen=True)
class Propensity:
    """Scores of being treated, (key, treat, score), and the encoded covariates they come from."""

    scores: DataFrame
    many: Many
    key: str

    def smd(self, kept: DataFrame | None = None) -> DataFrame:
        """(feature, smd) over every encoded covariate, of all rows or of those whose key is in the one-column table `kept`."""
        rows = self.many.rows if kept is None else self.many.rows.join(kept.toDF(self.key), self.key, "left_semi")
        c, t = group_moments(self.many, rows.withColumn("_g", F.col("_y").cast("int")), "_g", 2)
        p = len(self.many.names)
        n = [max(g[0], 1.0) for g in (c, t)]
        mean = [g[1 : 1 + p] / k for g, k in zip((c, t), n)]
        var = [np.maximum(g[1 + p :] - k * m * m, 0.0) / max(k - 1, 1.0) for g, k, m in zip((c, t), n, mean)]
        pooled = np.sqrt((var[0] + var[1]) / 2)
        out = np.abs(mean[1] - mean[0]) / np.where(pooled > 1e-12, pooled, 1e-8)
        rows = [(f, float(x)) for f, x in zip(self.many.names, out)]
        return self.many.rows.sparkSession.createDataFrame(rows, "feature string, smd double")


def propensity(df: DataFrame, treat: str, spec: FeatureSpec, key: str = "order_id") -> Propensity:
    """Balanced logistic probability of being treated, from median-filled, encoded and scaled covariates."""
    rows = df.select(key, F.col(treat), *spec.numeric, *spec.categorical, *spec.encoded).withColumns({"_fold": F.lit(1), "_tier": F.lit(0)})
    many = fit(prepare(rows, treat, spec.numeric, spec.categorical, spec.encoded, [Member(0, 0)], keep=[key, treat]))
    return Propensity(cut_lineage(keyed_scores(many, [key, treat]).withColumnRenamed("probability", "score")), many, key)


def _ranked_by_score(df: DataFrame, cell: Column, width: float, descending: bool) -> DataFrame:
    """Position inside the cell in score order.

    Rows of one score are numbered apart in 64 hash pieces; distinct scores are then
    ordered slice by slice, so neither a hot score nor a hot cell lands in one task.
    """
    placed = df.withColumn("cell", cell).where(F.col("cell").isNotNull()).withColumn("_h", F.xxhash64("key"))
    inner = ordinal(placed, ["cell", "score"], [F.col("_h"), F.col("key")], F.shiftright("_h", 58), "_in")
    scores = placed.groupBy("cell", "score").agg(F.count("*").alias("n"))
    sign = F.lit(-1.0 if descending else 1.0)
    slice_ = F.floor(F.col("score") * sign / F.lit(width / 1024))
    before = ordinal(scores, ["cell"], [F.col("score") * sign], slice_, "_before", weight="n")
    return inner.join(before.select("cell", "score", "_before"), ["cell", "score"]).select(
        "cell", (F.col("_before") + F.col("_in")).alias("pos"), "key", "score"
    )


def _pass(left: DataFrame, cell_t: Column, cell_c: Column, width: float, caliper: float, t_desc: bool, c_desc: bool) -> DataFrame:
    """Pairs the i-th treated with the i-th control of each cell when they lie inside the caliper."""
    t = _ranked_by_score(left.where(F.col("treated") == 1), cell_t, width, t_desc)
    c = _ranked_by_score(left.where(F.col("treated") == 0), cell_c, width, c_desc)
    c = c.select("cell", "pos", F.col("key").alias("control"), F.col("score").alias("control_score"))
    pairs = t.join(c, ["cell", "pos"])
    return pairs.where(F.abs(F.col("score") - F.col("control_score")) <= caliper).select(
        F.col("key").alias("treated_key"), F.col("control").alias("control_key"), "score", "control_score"
    )


def _neighbours(stacks: DataFrame, sides: dict[str, Column]) -> DataFrame:
    """Adds, per name, <name>_lo and <name>_hi: the nearest score below and above among the stacks whose column of `sides` is not null.

    Scores are cut into ranges; the last one of the ranges below and the first one of those above are carried in, so
    no task orders more than one range, or one row per range.
    """
    pieces = stacks.withColumn("_b", digit(F.col("score")))
    per = pieces.groupBy("_b").agg(*[f(c).alias(f"_{f.__name__}_{n}") for n, c in sides.items() for f in (F.max, F.min)])
    up, down = Window.orderBy("_b"), Window.orderBy(F.desc("_b"))
    before = (Window.unboundedPreceding, -1)
    carry = per.select("_b", *[f(f"_{f.__name__}_{n}").over(w.rowsBetween(*before)).alias(f"_c{e}_{n}") for n in sides for f, w, e in ((F.max, up, "lo"), (F.min, down, "hi"))])
    inside = Window.partitionBy("_b")
    low, high = inside.orderBy("score").rowsBetween(*before), inside.orderBy(F.desc("score")).rowsBetween(*before)
    local = pieces.select("*", *[f(c).over(w).alias(f"_w{e}_{n}") for n, c in sides.items() for f, w, e in ((F.max, low, "lo"), (F.min, high, "hi"))])
    pick = [F.coalesce(F.col(f"_w{e}_{n}"), F.col(f"_c{e}_{n}")).alias(f"{n}_{e}") for n in sides for e in ("lo", "hi")]
    return local.join(carry, "_b").select(*stacks.columns, *pick)


def _nearest_first(piece, caliper: float, open_low: bool, open_high: bool) -> tuple[list, list]:
    """(pairs, rows left) of one run of stacks in score order; pairs are (lower, upper, their used rows, rows paired).

    The closest two neighbours of different sides are paired first, of equally close ones the lower, as many rows as
    the smaller stack has. Beyond an open end there may be any stack: two stacks are paired only if that end
    is farther from them than they are from each other. Otherwise both wait, and become the end themselves.
    """
    s, side, n, used = (piece[c].tolist() for c in ("score", "treated", "n", "used"))
    before, after = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
    low, high = s[0] if open_low else -np.inf, s[-1] if open_high else np.inf
    heap = [(s[i + 1] - s[i], i, i + 1) for i in range(len(s) - 1) if side[i] != side[i + 1] and s[i + 1] - s[i] <= caliper]
    heapify(heap)
    pairs = []
    while heap:
        d, i, j = heappop(heap)
        if not n[i] or not n[j] or after[i] != j:
            continue
        if not s[i] - low > d or not high - s[j] >= d:
            if not s[i] - low > d:
                low = max(low, s[j])
            if not high - s[j] >= d:
                high = min(high, s[i])
            continue
        m = min(n[i], n[j])
        pairs.append((i, j, used[i], used[j], m))
        for k in (i, j):
            n[k] -= m
            used[k] += m
            if not n[k]:
                a, b = before[k], after[k]
                if a >= 0:
                    after[a] = b
                if b >= 0:
                    before[b] = a
                if a >= 0 and b >= 0 and side[a] != side[b] and s[b] - s[a] <= caliper:
                    heappush(heap, (s[b] - s[a], a, b))
    return pairs, [(s[i], side[i], n[i], used[i]) for i in range(len(s)) if n[i]]


def _round(stacks: DataFrame, n: int, caliper: float, piece_rows: int, shift: int) -> DataFrame:
    """(made, score, other, treated, used, other_used, n): pairs of stacks made inside pieces of the score order, with made set, and stacks left."""
    if n <= piece_rows:
        cut = stacks.withColumns({"_pos": F.lit(0), "_piece": F.lit(0)})
    else:
        placed = ordinal(stacks, [], [F.col("score")], digit(F.col("score")), "_pos")
        cut = placed.withColumn("_piece", F.floor((F.col("_pos") - 1 + shift) / F.lit(piece_rows)))
    last = (n - 1 + shift) // piece_rows if n > piece_rows else 0

    def run(piece):
        import pandas as pd

        piece = piece.sort_values("score")
        at = piece["_piece"].iloc[0]
        pairs, rest = _nearest_first(piece, caliper, at > 0, at < last)
        s, side = piece["score"].to_numpy(), piece["treated"].to_numpy()
        out = []
        for i, j, u, v, m in pairs:
            (t, tu), (c, cu) = ((i, u), (j, v)) if side[i] == 1 else ((j, v), (i, u))
            out.append((True, s[t], s[c], 1, tu, cu, m))
        out += [(False, x, None, k, u, None, m) for x, k, m, u in rest]
        return pd.DataFrame(out, columns=["made", "score", "other", "treated", "used", "other_used", "n"]).astype({"other": "float64", "other_used": "Int64"})

    return cut.groupBy("_piece").applyInPandas(run, "made boolean, score double, other double, treated int, used long, other_used long, n long")


def _possible(stacks: DataFrame, caliper: float) -> bool:
    """Whether two stacks of different sides stand inside the caliper."""
    seen = _neighbours(stacks, {"c": F.when(F.col("treated") == 0, F.col("score"))}).where("treated = 1")
    return bool(seen.where((F.col("score") - F.col("c_lo") <= caliper) | (F.col("c_hi") - F.col("score") <= caliper)).limit(1).count())


def _nearest_pairs(left: DataFrame, caliper: float, piece_rows: int = 200_000) -> tuple[DataFrame, bool]:
    """Pairs of rows with equal scores, then of mutual nearest neighbours, until no possible pair is left or a round makes none.

    Rows of a score are a stack. Two stacks that are each other's nearest on the other side stay so whatever else is
    paired, so all pairs inside a piece of the score order are made in one go, and only those wait that the next
    piece may change; each round moves the cuts by half a piece. Only stacks move; at the end the pairs are written out
    by places inside the stacks. The second result tells whether no possible pair is left.
    """
    counts = left.groupBy("score").agg(F.count_if(F.col("treated") == 1).alias("t"), F.count_if(F.col("treated") == 0).alias("c"))
    equal = F.least("t", "c")
    two = counts.select(
        F.col("score").alias("t_score"), F.col("score").alias("c_score"), F.lit(0).cast("long").alias("t_used"), F.lit(0).cast("long").alias("c_used"), equal.alias("m"),
        (F.col("t") > F.col("c")).cast("int").alias("treated"), F.abs(F.col("t") - F.col("c")).alias("n"),
    )
    two = cut_lineage(two)
    segments = two.where("m > 0").select("t_score", "c_score", "t_used", "c_used", "m")
    stacks = two.where("n > 0").select(F.col("t_score").alias("score"), "treated", "n", F.col("m").alias("used"))
    shift = 0
    while True:
        sides = stacks.agg(F.count("*").alias("n"), F.count_if(F.col("treated") == 1).alias("t")).first()
        settled = sides["t"] in (0, sides["n"])
        if settled:
            break
        done = cut_lineage(_round(stacks, sides["n"], caliper, piece_rows, shift))
        made = done.where("made").agg(F.count("*")).first()[0]
        pairs = done.where("made").select(F.col("score").alias("t_score"), F.col("other").alias("c_score"), F.col("used").alias("t_used"), F.col("other_used").alias("c_used"), F.col("n").alias("m"))
        segments = segments.unionByName(pairs)
        stacks = done.where("not made").select("score", "treated", "n", "used")
        settled = sides["n"] <= piece_rows or not _possible(stacks, caliper)
        if settled or (not made and shift):
            break
        shift = piece_rows // 2 - shift
    hashed = left.withColumn("_h", F.xxhash64("key"))
    placed = ordinal(hashed, ["score", "treated"], [F.col("_h"), F.col("key")], F.shiftright("_h", 58), "pos")
    each = segments.select("t_score", "c_score", "t_used", "c_used", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("_i"))
    each = each.select("t_score", "c_score", (F.col("t_used") + F.col("_i")).alias("t_pos"), (F.col("c_used") + F.col("_i")).alias("c_pos"))
    named = lambda side, k: placed.where(F.col("treated") == k).select(F.col("score").alias(f"{side}_score"), F.col("pos").alias(f"{side}_pos"), F.col("key").alias(f"{side}_key"))
    both = each.join(named("t", 1), ["t_score", "t_pos"]).join(named("c", 0), ["c_score", "c_pos"])
    return both.select(F.col("t_key").alias("treated_key"), F.col("c_key").alias("control_key"), F.col("t_score").alias("score"), F.col("c_score").alias("control_score")), settled


def psm_match(scores: DataFrame, treat: str, key: str = "order_id", caliper: float = 0.05) -> DataFrame:
    """1:1 matches on the score without reuse, none farther apart than the caliper, none left possible.

    First rows of equal scores are paired, then mutual nearest neighbours until none is left. Only where a run of one side
    is longer than a piece of the score order can rows remain; they then go through passes that pair equal ranks
    inside score cells, from cells far finer than the caliper to cells as wide as it, and edge to
    edge across their borders (highest treated with lowest control and the reverse). Two rows inside the
    caliper sit in the same or in neighbouring cells, so no possible pair remains.
    Rows without a score, key or treatment take no part.
    """
    rows = scores.select(F.col(key).alias("key"), F.col(treat).cast("int").alias("treated"), F.col("score").cast("double").alias("score"))
    left = cut_lineage(rows.where("key is not null and treated in (0, 1) and score is not null and not isnan(score)"))
    found, settled = _nearest_pairs(left, caliper)
    found = cut_lineage(found)

    def rest(pairs: DataFrame) -> DataFrame:
        used = pairs.select(F.explode(F.array("treated_key", "control_key")).alias("key"))
        return cut_lineage(left.join(used, "key", "left_anti"))

    if settled:
        return found
    left = rest(found)
    plans = [(caliper * s, None, None) for s in CELL_SHARES]
    plans += [(caliper, parity, up) for parity in (0, 1) for up in (True, False)]
    for width, parity, up in plans:
        sides = {r["treated"] for r in left.select("treated").distinct().collect()}
        if len(sides) < 2:
            break
        cell = F.floor(F.col("score") / F.lit(width))
        if parity is None:
            pairs = _pass(left, cell, cell, width, caliper, False, False)
        else:
            # border b joins cell b (below) with cell b + 1 (above); up: treated below, control above
            below, above = F.when(F.pmod(cell, F.lit(2)) == parity, cell), F.when(F.pmod(cell - 1, F.lit(2)) == parity, cell - 1)
            t_cell, c_cell = (below, above) if up else (above, below)
            pairs = _pass(left, t_cell, c_cell, width, caliper, up, not up)
        pairs = cut_lineage(pairs)
        found, left = found.unionByName(pairs), rest(pairs)
    return found


def match_check(scores: DataFrame, pairs: DataFrame, treat: str, caliper: float, key: str = "order_id") -> DataFrame:
    """One row: pairs of equal scores, keys used twice, pairs beyond the caliper, and unmatched treated rows that have an unmatched control inside it."""
    used = pairs.select(F.explode(F.array("treated_key", "control_key")).alias(key))
    twice = used.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("reused"))
    gap = F.abs(F.col("score") - F.col("control_score"))
    seen = pairs.agg(F.count_if(gap == 0).alias("same_score"), F.count_if(gap > caliper).alias("beyond_caliper"))
    left = scores.join(used.distinct(), key, "left_anti").where(F.col("score").isNotNull())
    stacks = left.groupBy("score").agg(F.count_if(F.col(treat) == 1).alias("t"), F.count_if(F.col(treat) == 0).alias("c"))
    near = _neighbours(stacks, {"_k": F.when(F.col("c") > 0, F.col("score"))})
    close = (F.col("c") > 0) | (F.col("score") - F.col("_k_lo") <= caliper) | (F.col("_k_hi") - F.col("score") <= caliper)
    possible = near.agg(F.coalesce(F.sum(F.when(close, F.col("t"))), F.lit(0)).alias("still_possible"))
    return with_row(with_row(seen, twice), possible).select("same_score", "reused", "beyond_caliper", "still_possible")


def smd(df: DataFrame, treat: str, features: Sequence[str]) -> DataFrame:
    """Absolute standardised mean difference per feature (pooled sample variance, 0 counted as 1e-8)."""
    structs = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]
    is_t = F.col("t") == 1
    side = lambda f, cond: f(F.when(cond, F.col("v")))
    stats = df.select(F.col(treat).alias("t"), F.inline(F.array(*structs))).groupBy("feature").agg(
        side(F.avg, is_t).alias("mt"), side(F.avg, ~is_t).alias("mc"), side(F.var_samp, is_t).alias("vt"), side(F.var_samp, ~is_t).alias("vc")
    )
    pooled = F.sqrt((F.col("vt") + F.col("vc")) / 2)
    pooled = F.when(pooled == 0, F.lit(1e-8)).otherwise(pooled)
    return stats.select("feature", F.abs((F.col("mt") - F.col("mc")) / pooled).alias("smd"))


def balance(before: DataFrame, after: DataFrame, limit: float = 0.1) -> DataFrame:
    """Largest SMD before and after matching and the share of features below the limit after."""
    a = before.agg(F.max("smd").alias("max_before"))
    return with_row(a, after.agg(F.max("smd").alias("max_after"), F.avg((F.col("smd") < limit).cast("double")).alias("share_below")))


def att(pairs: DataFrame, treated_outcome: str, control_outcome: str) -> DataFrame:
    """Mean outcome difference over pairs with its 95 % interval."""
    d = (F.col(treated_outcome) - F.col(control_outcome)).cast("double")
    stats = pairs.agg(F.count(d).alias("pairs"), F.avg(d).alias("att"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("_sd"))
    se = F.coalesce(F.try_divide(F.col("_sd"), F.sqrt("pairs")), F.lit(0.0))
    return stats.select("pairs", "att", (F.col("att") - 1.96 * se).alias("ci_low"), (F.col("att") + 1.96 * se).alias("ci_high"))


def matched_rows(df: DataFrame, pairs: DataFrame, key: str = "order_id") -> DataFrame:
    """The rows taking part in a match."""
    used = pairs.select(F.explode(F.array("treated_key", "control_key")).alias(key))
    return df.join(used, key, "left_semi")


def paired_outcomes(df: DataFrame, pairs: DataFrame, outcome: str, key: str = "order_id") -> DataFrame:
    t = df.select(F.col(key).alias("treated_key"), F.col(outcome).alias("treated_outcome"))
    c = df.select(F.col(key).alias("control_key"), F.col(outcome).alias("control_outcome"))
    return pairs.join(t, "treated_key").join(c, "control_key")
