"""Association mining over configuration rows.

A row's items are an array built in one projection and identical rows are counted first. Itemsets grow level
by level: the rows of a block give one bitmap per item, and a set's support is the weight of the
rows in all its bitmaps.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from launchlens.functions.semantics import ratio
from launchlens.plans.selection import exact_quantiles
from launchlens.session import cut_lineage

ALL = "all"


def _class_col(by: str | None) -> Column:
    return F.col(by).cast("string") if by else F.lit(ALL)


def _numeric_long(df: DataFrame, by: str | None, numeric: Sequence[str]) -> DataFrame:
    structs = [F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in numeric]
    return df.select(_class_col(by).alias("cls"), F.inline(F.array(*structs))).where(F.col("v").isNotNull())


def column_kinds(df: DataFrame, columns: Sequence[str], by: str | None = None, small_int: int = 10) -> tuple[dict[str, str], DataFrame | None]:
    """flag, binary, category or binned per column, and the tercile edges of the binned ones per class.

    The values of the numeric columns are counted once; both their kind and their edges come from
    the counts, and one row per column reaches the driver.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    kinds = {}
    for c in columns:
        if isinstance(types[c], T.BooleanType):
            kinds[c] = "flag"
        elif not isinstance(types[c], T.NumericType):
            kinds[c] = "category"
    numeric = [c for c in columns if c not in kinds]
    if not numeric:
        return kinds, None
    counts = cut_lineage(_numeric_long(df, by, numeric).groupBy("cls", "c", "v").agg(F.count("*").alias("n")))
    values = counts.groupBy("c", "v").agg(F.lit(1).alias("_one")).groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    seen = {row["c"]: row for row in values.collect()}
    for c in numeric:
        row = seen.get(c)
        if row is None or (row["n"] <= 2 and row["lo"] in (0.0, 1.0) and row["hi"] in (0.0, 1.0)):
            kinds[c] = "binary"
        else:
            kinds[c] = "category" if isinstance(types[c], T.IntegralType) and row["n"] <= small_int else "binned"
    binned = counts.where(F.col("c").isin([c for c in numeric if kinds[c] == "binned"]))
    return kinds, exact_quantiles(binned, ["cls", "c"], "v", [1 / 3, 2 / 3], weight="n")


def _edges_per_class(edges: DataFrame, binned: Sequence[str]) -> DataFrame:
    """One row per class with the two inner edges of every binned column."""
    return edges.groupBy("cls").agg(
        *[F.max(F.when(F.col("c") == c, F.col(f"q{k}"))).alias(f"_e{k}_{i}") for i, c in enumerate(binned) for k in (0, 1)]
    )


def itemize(
    df: DataFrame, columns: Sequence[str], min_support: float = 0.05, max_categories: int | None = None, by: str | None = None
) -> DataFrame:
    """(cls, items, n): distinct item rows per class with their count.

    Items are <column>=<value>; flags and 0/1 columns give one item; other numerics fall into
    three quantile bins; nulls are a value of their own. Values below min_support are
    dropped, and those beyond max_categories per column if the caller sets it.
    """
    kinds, edges = column_kinds(df, columns, by)
    binned = [c for c in columns if kinds[c] == "binned"]
    rows = df.withColumn("cls", _class_col(by)).where(F.col("cls").isNotNull())
    if binned:
        rows = rows.join(_edges_per_class(edges, binned), "cls", "left")
    parts = []
    for c in columns:
        v = F.col(c)
        if kinds[c] == "flag":
            parts.append(F.when(v, F.lit(f"{c}=True")))
        elif kinds[c] == "binary":
            parts.append(F.when(v == 1, F.lit(f"{c}=1")))
        elif kinds[c] == "binned":
            i = binned.index(c)
            label = F.when(v.isNull(), "nan").when(v <= F.col(f"_e0_{i}"), "q1").when(v <= F.col(f"_e1_{i}"), "q2").otherwise("q3")
            parts.append(F.concat(F.lit(f"{c}="), label))
        else:
            parts.append(F.concat(F.lit(f"{c}="), F.coalesce(v.cast("string"), F.lit("nan"))))
    # distinct item rows: bounded by the combinations of kept values, read several times below
    raw = cut_lineage(
        rows.select("cls", F.array_compact(F.array(*parts)).alias("items")).groupBy("cls", "items").agg(F.count("*").alias("n"))
    )
    kept = item_support(raw).where(F.col("support") >= min_support)
    place = F.row_number().over(Window.partitionBy("cls", F.substring_index("item", "=", 1)).orderBy(F.col("support").desc(), "item"))
    if max_categories is not None:
        kept = kept.withColumn("_r", place).where(F.col("_r") <= max_categories)
    frequent = kept.groupBy("cls").agg(F.collect_list("item").alias("_kept"))  # at most 1 / min_support values per column
    pruned = raw.join(frequent, "cls", "left").withColumn(
        "items", F.array_sort(F.array_intersect("items", F.coalesce("_kept", F.array().cast("array<string>"))))
    )
    return pruned.groupBy("cls", "items").agg(F.sum("n").alias("n"))


def class_sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("cls").agg(F.sum("n").alias("rows"))


def item_support(items: DataFrame) -> DataFrame:
    """Count and support of single items per class."""
    single = items.select("cls", F.explode("items").alias("item"), "n").groupBy("cls", "item").agg(F.sum("n").alias("count"))
    return single.join(class_sizes(items), "cls").withColumn("support", ratio(F.col("count"), F.col("rows"))).drop("rows")


#: Candidate sets whose bitmaps are taken together at once inside a task.
CANDIDATE_BLOCK = 2048


def _next_candidates(frequent: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Sets of one more item all of whose subsets are frequent: two sets that differ in their last item, joined."""
    known, out = set(frequent), []
    for _, group in itertools.groupby(sorted(frequent), key=lambda t: t[:-1]):
        for a, b in itertools.combinations(list(group), 2):
            joined = (*a, b[-1])
            if len(joined) == 2 or all(joined[:k] + joined[k + 1 :] in known for k in range(len(joined) - 2)):
                out.append(joined)
    return out


def _candidate_counts(items: DataFrame, names: dict[str, list[str]], candidates: dict[str, list[tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Rows that hold each candidate set, per class, in one pass over the distinct item rows.

    A task turns a block of rows into one bitmap per item and takes the bitmaps of a set together; what it
    sends is one number per class and candidate.
    """
    place = {cls: {item: i for i, item in enumerate(listed)} for cls, listed in names.items()}
    sets = {cls: np.array(c, np.int64) for cls, c in candidates.items() if c}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        totals = {cls: np.zeros(len(c), np.int64) for cls, c in sets.items()}
        for batch in batches:
            classes, rows, weights = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            for cls in set(classes) & set(sets):
                mine = [k for k, c in enumerate(classes) if c == cls]
                holds = np.zeros((len(place[cls]), len(mine)), bool)
                for at, k in enumerate(mine):
                    holds[[place[cls][x] for x in rows[k] if x in place[cls]], at] = True
                bits, n = np.packbits(holds, axis=1), weights[mine].astype(np.int64)
                for lo in range(0, len(sets[cls]), CANDIDATE_BLOCK):
                    part = sets[cls][lo : lo + CANDIDATE_BLOCK]
                    both = bits[part[:, 0]]
                    for k in range(1, part.shape[1]):
                        both &= bits[part[:, k]]
                    totals[cls][lo : lo + CANDIDATE_BLOCK] += np.unpackbits(both, axis=1, count=len(mine)).astype(np.int64) @ n
        for cls, total in totals.items():
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([cls] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["cls", "i", "n"])

    out = {cls: np.zeros(len(c), np.int64) for cls, c in candidates.items()}
    summed = items.select("cls", "items", F.col("n").cast("long").alias("n")).mapInArrow(run, "cls string, i int, n long").groupBy("cls", "i").agg(F.sum("n").alias("n"))
    for row in summed.collect():
        out[row["cls"]][row["i"]] = row["n"]
    return out


def frequent_sets(items: DataFrame, supports: Sequence[float]) -> list[tuple[str, tuple[str, ...], int, int]]:
    """(class, sorted items, rows that hold them, rows of the class) of the sets of size k with a support of supports[k - 1] or more.

    Level by level: the candidates of a size come from the frequent sets one smaller, and one pass counts all of them. The
    number of frequent sets is bounded by the columns and the support, not by the rows: a row of m items adds to C(m, k)
    sets, so at most C(m, k) / support sets of size k are frequent in a class.
    """
    items = cut_lineage(items)
    rows = {r["cls"]: r["rows"] for r in class_sizes(items).collect()}
    single = items.select("cls", F.explode("items").alias("item"), "n").groupBy("cls", "item").agg(F.sum("n").alias("count"))
    listed = single.join(class_sizes(items), "cls").where(ratio(F.col("count"), F.col("rows")) >= supports[0]).orderBy("cls", "item").collect()
    names: dict[str, list[str]] = {}
    out, level = [], {}
    for r in listed:
        names.setdefault(r["cls"], []).append(r["item"])
        level.setdefault(r["cls"], []).append((len(names[r["cls"]]) - 1,))
        out.append((r["cls"], (r["item"],), r["count"], rows[r["cls"]]))
    for least in supports[1:]:
        candidates = {cls: _next_candidates(sets) for cls, sets in level.items()}
        if not any(candidates.values()):
            break
        counts = _candidate_counts(items, names, candidates)
        level = {}
        for cls, found in candidates.items():
            for k in np.flatnonzero(counts[cls] / rows[cls] >= least).tolist():
                level.setdefault(cls, []).append(found[k])
                out.append((cls, tuple(names[cls][i] for i in found[k]), int(counts[cls][k]), rows[cls]))
    return out


def freq_itemsets(items: DataFrame, min_support: float = 0.05, max_len: int = 3) -> DataFrame:
    """(cls, itemset, size, count, support) of all itemsets up to max_len items."""
    found = [(cls, list(names), len(names), n, n / rows) for cls, names, n, rows in frequent_sets(items, [min_support] * max_len)]
    return items.sparkSession.createDataFrame(found, "cls string, itemset array<string>, size int, count long, support double")


def assoc_rules(itemsets: DataFrame, min_lift: float = 1.0, min_confidence: float = 0.6) -> DataFrame:
    """Rules over every split of every itemset into antecedent and consequent.

    Every subset of a frequent itemset is itself frequent, so both supports are found
    by equality joins on the itemset.
    """
    itemsets = cut_lineage(itemsets)
    multi = itemsets.where(F.col("size") >= 2)
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.col("size")) - 2).cast("int"))
    split = multi.withColumn("_mask", F.explode(masks))
    bit = lambda i: F.shiftright(F.col("_mask"), 0).bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0
    sides = split.select(
        "cls", "support",
        F.filter("itemset", lambda _, i: bit(i)).alias("antecedent"),
        F.filter("itemset", lambda _, i: ~bit(i)).alias("consequent"),
    )
    lookup = lambda name: itemsets.select("cls", F.col("itemset").alias(name), F.col("support").alias(f"{name}_support"))
    joined = sides.join(lookup("antecedent"), ["cls", "antecedent"]).join(lookup("consequent"), ["cls", "consequent"])
    a, c = F.col("antecedent_support"), F.col("consequent_support")
    confidence = ratio(F.col("support"), a)
    rules = joined.select(
        "cls",
        F.array_join("antecedent", " & ").alias("antecedent"),
        F.array_join("consequent", " & ").alias("consequent"),
        "support",
        confidence.alias("confidence"),
        ratio(F.col("support"), a * c).alias("lift"),
        (F.col("support") - a * c).alias("leverage"),
        F.try_divide(F.lit(1.0) - c, F.lit(1.0) - confidence).alias("conviction"),
    )
    return rules.where((F.col("lift") >= min_lift) & (F.col("confidence") >= min_confidence))


def onehot_support(df: DataFrame, columns: Sequence[str], min_support: float = 0.03, max_categories: int | None = None) -> DataFrame:
    """Text values that become one-hot features: (column, value, n, share), nulls counted as 'NA'."""
    structs = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias("value")) for c in columns]
    counts = df.select(F.inline(F.array(*structs))).groupBy("column", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("_rows"))
    # at most 1 / min_support values per column are left to be ranked
    kept = counts.join(totals, "column").withColumn("share", ratio(F.col("n"), F.col("_rows"))).where(F.col("share") >= min_support)
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "value"))
    if max_categories is not None:
        kept = kept.withColumn("_r", place).where(F.col("_r") <= max_categories)
    return kept.select("column", "value", "n", "share")


def interactions(
    df: DataFrame, columns: Sequence[str], min_support: float = 0.03, min_joint: float = 0.01, top: int | None = None, max_pairs: int | None = None
) -> DataFrame:
    """Pairs of one-hot features from different columns by joint support, in order of prevalence.

    `top` features and `max_pairs` pairs are kept only if the caller sets them.
    """
    values = onehot_support(df, columns, min_support)
    ranked = values.orderBy(F.col("n").desc(), F.concat("column", F.lit("="), "value")).collect()  # at most 1 / min_support values per column
    if top is not None:
        ranked = ranked[:top]
    rank = {f"{r['column']}={r['value']}": k for k, r in enumerate(ranked, 1)}
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NA"))) for c in columns]
    kept = F.array_intersect(F.array(*parts), F.array(*[F.lit(name) for name in rank]).cast("array<string>"))
    rows = df.select(F.lit(ALL).alias("cls"), kept.alias("items")).groupBy("cls", "items").agg(F.count("*").alias("n"))
    pairs = []
    for _, names, n, total in frequent_sets(rows, [0.0, min_joint]):
        if len(names) == 2:
            a, b = sorted(names, key=rank.get)
            pairs.append((rank[a], rank[b], a, b, n, n / total))
    pairs.sort()
    schema = "rank_a int, rank_b int, a string, b string, n long, joint_support double"
    return df.sparkSession.createDataFrame(pairs if max_pairs is None else pairs[:max_pairs], schema)
