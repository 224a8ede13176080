"""Plan shapes that stay whole and balanced when one key holds a large part of the rows.

Every helper is exact. The common idea: work inside (key, bucket) pieces, where the
bucket is a monotone function of the order column, and carry over what earlier
buckets contribute from a table that has one row per (key, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from launchlens.functions.semantics import as_col


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by `order`.

    min_by is an aggregate with a map-side combine, so a hot key sends one row per
    map task instead of all of its rows. `order` must be unique inside a key.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the last by `order`."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, out: str = "ordinal", weight: str | None = None
) -> DataFrame:
    """1-based position inside each key group, counted piecewise per (key, bucket).

    The bucket must be monotone in the order. With no keys this is a whole-table
    numbering in which no task sees more than one bucket of rows. With a weight column
    the result is the sum of the weights of all rows before the row instead.
    """
    keys = list(keys)
    pieces = df.withColumn("_b", bucket)
    one = F.count("*") if weight is None else F.sum(weight)
    sizes = pieces.groupBy(*keys, "_b").agg(one.alias("_n"))
    before = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*[F.col(k) for k in keys], F.col("_b")).orderBy(*order)
    if weight is None:
        local = F.row_number().over(inside)
    else:
        local = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = pieces.withColumn("_rn", local)
    return numbered.join(offsets, [*keys, "_b"]).select(*df.columns, (F.col("_off") + F.col("_rn")).alias(out))


def running_extreme(
    df: DataFrame,
    keys: Sequence[str],
    pos: str | Column,
    bucket: Column,
    values: dict[str, tuple[str, Column]],
    ties: Sequence[Column] | None = None,
    later: bool = False,
    count_as: str | None = None,
) -> DataFrame:
    """Adds, per output name, the min or max of a column over the rows before each row.

    `values` maps output name to ('min' | 'max', column). `later=True` looks at the
    rows after instead. Without `ties` only strictly earlier positions count (`pos`
    numeric); with `ties` rows are ordered by (pos, ties) and all earlier rows count.
    `count_as` also adds the number of rows of the key.
    """
    keys = list(keys)
    fns = {"min": F.min, "max": F.max}
    pick = {"min": F.least, "max": F.greatest}
    pieces = df.withColumn("_b", bucket).withColumn("_p", as_col(pos) if not later else -as_col(pos))
    side = F.col("_b").desc() if later else F.col("_b").asc()
    per = pieces.groupBy(*keys, "_b").agg(F.count("*").alias("_n"), *[fns[f](c).alias(f"_m_{o}") for o, (f, c) in values.items()])
    whole = Window.partitionBy(*keys)
    prev = whole.orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
    totals = [F.sum("_n").over(whole).alias(count_as)] if count_as else []
    carry = per.select(*keys, "_b", *totals, *[fns[f](f"_m_{o}").over(prev).alias(f"_c_{o}") for o, (f, _) in values.items()])
    inside = Window.partitionBy(*keys, "_b")
    if ties is None:
        inside = inside.orderBy("_p").rangeBetween(Window.unboundedPreceding, -1)
    else:
        inside = inside.orderBy("_p", *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = pieces.select("*", *[fns[f](c).over(inside).alias(f"_w_{o}") for o, (f, c) in values.items()])
    merged = local.join(carry, [*keys, "_b"])
    return merged.select(
        *df.columns,
        *([count_as] if count_as else []),
        *[pick[f](F.col(f"_c_{o}"), F.col(f"_w_{o}")).alias(o) for o, (f, _) in values.items()],
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], value: str, bucket: Column, out: str
) -> DataFrame:
    """lag(value) over rows that are unique in (keys, value), piecewise per (key, bucket)."""
    return running_extreme(df, keys, F.lit(0), bucket, {out: ("max", F.col(value))}, ties=[F.col(value)])


def join_null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys where null meets null; b's key copies are dropped."""
    renamed = b.select(*[F.col(c).alias(f"{c}_r") if c in keys else F.col(c) for c in b.columns])
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{c}_r"))
    return a.join(renamed, cond).drop(*[f"{c}_r" for c in keys])


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row table to every row, as a scalar subquery rather than a join."""
    packed = row.select(F.struct(*row.columns).alias("_r")).scalar()
    return df.withColumn("_r", packed).select(*df.columns, "_r.*")


def range_join(rows: DataFrame, ts: str, ranges: DataFrame, start: str, end: str) -> DataFrame:
    """Rows joined to every [start, end] range that holds ts, as an equi-join on months.

    Each range is repeated once per month it touches, so the join has a hash key and
    needs neither a nested loop nor a broadcast; Spark still broadcasts the ranges
    when their measured size allows it.
    """
    months = F.sequence(
        F.trunc(F.to_date(F.col(start)), "month"), F.trunc(F.to_date(F.col(end)), "month"), F.expr("interval 1 month")
    )
    keyed = ranges.withColumn("_month", F.explode(months))
    left = rows.withColumn("_month", F.trunc(F.to_date(F.col(ts)), "month"))
    return left.join(keyed, "_month").where(
        (F.col(ts) >= F.col(start).cast("timestamp")) & (F.col(ts) <= F.col(end).cast("timestamp"))
    ).drop("_month")
