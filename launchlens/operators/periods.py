"""Launch periods: the period table and the ways orders meet it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from launchlens.functions.semantics import in_period, norm_key, plus_days
from launchlens.plans.skew import range_join


def periods_table(spark: SparkSession, periods: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(grp, start_date, end_date) from literals; being a literal its size is known to the planner."""
    rows = [
        F.struct(F.lit(g).alias("grp"), F.lit(s).cast("date").alias("start_date"), F.lit(e).cast("date").alias("end_date"))
        for g, (s, e) in periods.items()
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def period_slice(df: DataFrame, periods: DataFrame, end_mode: str = "midnight") -> DataFrame:
    """Rows per period by pay time whatever their own group; a row can fall in several.

    The row's own group stays in `grp`, the period's name is `period`.
    """
    p = periods.select(
        F.col("grp").alias("period"), "start_date",
        (F.date_add("end_date", 1) if end_mode == "whole_day" else F.col("end_date")).alias("_until"), "end_date",
    )
    out = range_join(df, "pay_time", p, "start_date", "_until")
    if end_mode == "whole_day":
        out = out.where(F.col("pay_time") < F.col("_until").cast("timestamp"))
    return out.drop("_until")


def any_period(df: DataFrame, periods: DataFrame) -> DataFrame:
    """Orders paid inside at least one period, each once.

    Overlapping periods are merged first so the join cannot repeat a row.
    """
    w = Window.orderBy("start_date", "end_date")
    reach = F.max("end_date").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # one row per launch: the period table is configuration, not data
    islands = (
        periods.select("start_date", "end_date")
        .withColumn("_new", F.when(reach >= F.col("start_date"), 0).otherwise(1))
        .withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_island")
        .agg(F.min("start_date").alias("_from"), F.max("end_date").alias("_to"))
        .drop("_island")
    )
    return range_join(df, "pay_time", islands, "_from", "_to").drop("_from", "_to")


def group_period(df: DataFrame, periods: DataFrame) -> DataFrame:
    """Orders joined to their own group's period on the normalised name; `grp` takes the period's spelling."""
    p = periods.select(norm_key("grp").alias("_g"), F.col("grp").alias("_name"), "start_date", "end_date")
    joined = df.withColumn("_g", norm_key("grp")).join(p, "_g")
    return joined.withColumn("grp", F.col("_name")).drop("_g", "_name")


def exclude_groups(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop groups by normalised name; rows without a group stay."""
    drop = [norm_key(F.lit(n)) for n in names]
    return df.where(F.col("grp").isNull() | ~norm_key("grp").isin(drop))


def lock_window_filter(df: DataFrame, periods: DataFrame, n: int = 30) -> DataFrame:
    """Orders locked in [end, end + n days) of their own group."""
    lock = F.col("lock_time")
    return (
        group_period(df, periods)
        .where((lock >= F.col("end_date").cast("timestamp")) & (lock < plus_days("end_date", n)))
        .drop("start_date", "end_date")
    )


def presale(df: DataFrame, periods: DataFrame, end_mode: str = "midnight") -> DataFrame:
    """Orders of a group paid inside the group's own period."""
    return group_period(df, periods).where(in_period("pay_time", end_mode))
