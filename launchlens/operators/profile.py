"""Data-quality profiling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from launchlens.functions.semantics import count_if, ratio
from launchlens.plans.selection import counted_moments, exact_quantiles, value_counts
from launchlens.plans.skew import with_row

_DATE_WORDS = ("time", "date", "时间", "日期")


def type_class(field: T.StructField) -> str:
    """numeric, datetime, boolean or text by type; a text column named like a time counts as datetime."""
    if isinstance(field.dataType, T.NumericType):
        return "numeric"
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(field.dataType, T.BooleanType):
        return "boolean"
    return "datetime" if any(w in field.name.lower() for w in _DATE_WORDS) else "text"


def profile_columns(df: DataFrame) -> DataFrame:
    """Per column: type class, nulls and null share. One scan."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(F.lit(f.name).alias("column"), F.lit(type_class(f)).alias("type_class"), (F.col("_rows") - F.col(f"_c{i}")).alias("nulls"),
                 (ratio(F.col("_rows") - F.col(f"_c{i}"), F.col("_rows")) * 100).alias("null_pct"))
        for i, f in enumerate(df.schema.fields)
    ]
    return counts.select(F.inline(F.array(*rows)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group, nulls equal.

    Rows are compared by a 128-bit digest pair, so the shuffle carries 16 bytes a row
    instead of the whole row.
    """
    # a map has no hash of its own
    cols = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    keyed = df.select(F.xxhash64(*cols).alias("_h1"), F.xxhash64(F.lit("second"), *cols, *[c.isNull() for c in cols]).alias("_h2"))
    return keyed.groupBy("_h1", "_h2").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows")
    )


def quality_grade(completeness_pct: Column) -> Column:
    return (
        F.when(completeness_pct >= 95, "excellent").when(completeness_pct >= 90, "good")
        .when(completeness_pct >= 80, "fair").otherwise("poor")
    )


def profile_table(df: DataFrame) -> DataFrame:
    """One row: rows, columns, columns per type class, completeness, duplicates, grade."""
    n_cols = len(df.columns)
    classes = [type_class(f) for f in df.schema.fields]
    known = sum((F.count(F.col(f"`{c}`")) for c in df.columns), F.lit(0))
    rows = df.agg(F.count("*").alias("rows"), (F.count("*") * n_cols - known).alias("null_cells"))
    cells = F.col("rows") * n_cols
    complete = (F.lit(1.0) - ratio(F.col("null_cells"), cells)) * 100
    return with_row(rows, duplicate_rows(df)).select(
        "rows", F.lit(n_cols).alias("columns"),
        *[F.lit(classes.count(k)).alias(f"{k}_columns") for k in ("numeric", "datetime", "text")],
        "null_cells", complete.alias("completeness_pct"), "duplicate_rows", quality_grade(complete).alias("grade"),
    )


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per numeric column; quartiles exact, the table read once."""
    structs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]
    counts = value_counts(df.select(F.inline(F.array(*structs))).where(F.col("v").isNotNull()), ["column"], "v")
    stats = counted_moments(counts, ["column"]).select("column", "count", "mean", F.col("std_samp").alias("std"), "min", "max")
    q = exact_quantiles(counts, ["column"], "v", [0.25, 0.5, 0.75], weight="n").toDF("column", "q25", "median", "q75")
    return stats.join(q, "column")


def date_spans(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """First and last value per time column."""
    agg = df.agg(*[f(c).alias(f"_{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"_lo{i}").cast("timestamp").alias("first"), F.col(f"_hi{i}").cast("timestamp").alias("last")) for i, c in enumerate(cols)]
    return agg.select(F.inline(F.array(*rows)))


def null_profile(df: DataFrame, key: str, col: str, k: int = 10) -> DataFrame:
    """Null share of a column over rows distinct in the key, with its top-k values as long rows.

    Among rows sharing a key the smallest non-null value stands for the key.
    """
    uniq = df.groupBy(key).agg(F.min(col).alias("v"))
    counts = uniq.groupBy("v").agg(F.count("*").alias("n"))
    head = counts.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))
    totals = head.select(
        F.inline(
            F.array(
                F.struct(F.lit("rows").alias("section"), F.lit("").alias("value"), F.col("rows").alias("n"), F.lit(1.0).alias("share")),
                F.struct(F.lit("nulls").alias("section"), F.lit("").alias("value"), F.col("nulls").alias("n"), ratio(F.col("nulls"), F.col("rows")).alias("share")),
            )
        )
    )
    top = counts.where(F.col("v").isNotNull()).orderBy(F.col("n").desc(), "v").limit(k)
    tops = with_row(top, head).select(
        F.lit("top").alias("section"), F.col("v").cast("string").alias("value"), "n", ratio(F.col("n"), F.col("rows")).alias("share")
    )
    return totals.unionByName(tops)
