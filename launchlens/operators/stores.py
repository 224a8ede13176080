"""Store health from the order table: one aggregate per store, then small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from launchlens.functions.semantics import bucket, count_if, interval_days, ratio
from launchlens.session import cut_lineage

STATUSES = ("active", "suspected_closed", "not_open")


def _first_known(value: str) -> Column:
    """Value of the store's first order (by create time, order id) that has one."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct("create_time", "order_id")))


def store_status(df: DataFrame, as_of: str | None = None, threshold: int = 30) -> DataFrame:
    """Per store: attributes, orders, locks, last order and lock, days since, days open, status.

    The observation time is given, or the last order's, which is taken from the rows per store.
    """
    stores = df.groupBy("store").agg(
        _first_known("store_city").alias("store_city"),
        _first_known("region").alias("region"),
        _first_known("store_created").alias("store_created"),
        F.max("create_time").alias("last_order_time"),
        F.count("order_id").alias("orders"),
        F.count("lock_time").alias("locks"),
        F.max("lock_time").alias("last_lock_time"),
    )
    if as_of is None:
        stores = cut_lineage(stores)
        observed = stores.agg(F.max(F.col("last_order_time").cast("timestamp"))).scalar()
    else:
        observed = F.lit(as_of).cast("timestamp")
    rows = stores.where(F.col("store").isNotNull()).withColumn("_as_of", observed)
    since = interval_days("last_order_time", "_as_of")
    opened = F.coalesce(F.col("store_created").cast("timestamp") <= F.col("_as_of"), F.lit(False))
    status = F.when(~opened, "not_open").when(since > threshold, "suspected_closed").otherwise("active")
    return rows.select(
        "store", "store_city", "region", "store_created", "last_order_time", since.alias("days_since"),
        interval_days("store_created", "last_order_time").alias("days_open"),
        "orders", "locks", "last_lock_time", status.alias("status"),
    )


def store_status_totals(status: DataFrame) -> DataFrame:
    """Stores per status with the closure rate."""
    return status.agg(
        F.count("*").alias("stores"),
        *[count_if(F.col("status") == s).alias(s) for s in STATUSES],
    ).withColumn("closure_rate_pct", ratio(F.col("suspected_closed"), F.col("stores")) * 100)


def store_by(status: DataFrame, dim: Column, name: str) -> DataFrame:
    """Stores per value and status."""
    return (
        status.groupBy(dim.alias(name)).agg(*[count_if(F.col("status") == s).alias(s) for s in STATUSES])
        .where(F.col(name).isNotNull())
    )


def store_by_year(status: DataFrame) -> DataFrame:
    """Stores by the year of their last order; the total leaves out stores not yet open."""
    return store_by(status, F.year("last_order_time"), "year").withColumn("stores", F.col("active") + F.col("suspected_closed"))


def store_by_with_locks(df: DataFrame, status: DataFrame, dim: str) -> DataFrame:
    """Stores per value and status with the locks of the orders carrying that value."""
    locks = df.where(F.col("lock_time").isNotNull() & F.col(dim).isNotNull()).groupBy(dim).agg(F.count("*").alias("locks"))
    return store_by(status, F.col(dim), dim).join(locks, dim, "left").withColumn("locks", F.coalesce("locks", F.lit(0)))


# Day bins of the recency histogram, left-closed.
RECENCY_EDGES = (0, 1, 7, 30, 60, 180, 365, None)
RECENCY_LABELS = ("0-1", "1-7", "7-30", "30-60", "60-180", "180-365", "365+")


def recency_hist(status: DataFrame) -> DataFrame:
    """Stores by days since their last order; empty bins are kept."""
    bins = status.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in RECENCY_LABELS])).alias("bin"))
    counts = status.groupBy(bucket("days_since", RECENCY_EDGES, RECENCY_LABELS).alias("bin")).agg(F.count("*").alias("stores"))
    return bins.join(counts, "bin", "left").withColumn("stores", F.coalesce("stores", F.lit(0)))


def store_city_top(status: DataFrame, k: int = 20) -> DataFrame:
    """Cities with most stores; ties by name."""
    return (
        status.where(F.col("store_city").isNotNull()).groupBy("store_city").agg(F.count("*").alias("stores"))
        .orderBy(F.col("stores").desc(), "store_city").limit(k)
    )


def product_distinct_orders(df: DataFrame) -> DataFrame:
    """Distinct orders per trimmed product name."""
    name = F.trim("product")
    return (
        df.where(name.isNotNull() & (name != "")).groupBy(name.alias("product")).agg(F.count_distinct("order_id").alias("orders"))
    )
