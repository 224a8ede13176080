"""Time, share and banding rules shared by all operators; pure Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

MICROS_PER_DAY = 86_400_000_000


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: str | Column) -> Column:
    """Microseconds since the epoch; NTZ values are cast because unix_micros rejects them."""
    return F.unix_micros(as_col(c).cast("timestamp"))


def interval_days(a: str | Column, b: str | Column, whole: bool = True) -> Column:
    """Days from a to b. Whole days floor the elapsed time, so twelve hours back is -1."""
    days = (micros(b) - micros(a)) / F.lit(float(MICROS_PER_DAY))
    return F.floor(days) if whole else days


def day_index(ts: str | Column, start: str | Column) -> Column:
    """Calendar day number, the start day being day 1."""
    return F.datediff(F.to_date(as_col(ts)), as_col(start)) + 1


def days_from_end(ts: str | Column, end: str | Column) -> Column:
    """Calendar days after the end day, the end day being day 0."""
    return F.datediff(F.to_date(as_col(ts)), as_col(end))


def midnight(d: str | Column) -> Column:
    return as_col(d).cast("timestamp")


def plus_days(d: str | Column, n: int | Column) -> Column:
    """Midnight n days after date d."""
    return F.date_add(as_col(d), n).cast("timestamp")


def in_period(ts: str | Column, end_mode: str = "midnight") -> Column:
    """ts inside [start_date, end_date]; 'midnight' drops the end day after 00:00, 'whole_day' keeps it."""
    t = as_col(ts)
    after = t >= midnight("start_date")
    if end_mode == "midnight":
        return after & (t <= midnight("end_date"))
    if end_mode == "whole_day":
        return after & (t < plus_days("end_date", 1))
    raise ValueError(f"unknown end_mode {end_mode!r}")


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b as double; division by zero gives the default (None keeps null)."""
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if default is None else F.coalesce(r, F.lit(default))


def rel_change(a: Column, b: Column) -> Column:
    """(a - b) / b, null where b is 0."""
    return ratio(a - b, b, None)


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def bucket(
    col: str | Column,
    edges: Sequence[float],
    labels: Sequence[str],
    closed: str = "left",
    null_label: str | None = None,
) -> Column:
    """Label by interval. edges has one more entry than labels; None at an end leaves it open."""
    if len(edges) != len(labels) + 1:
        raise ValueError("edges must be one longer than labels")
    c = as_col(col)
    out = F.when(c.isNull(), F.lit(null_label))
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & ((c >= lo) if closed == "left" else (c > lo))
        if hi is not None:
            cond = cond & ((c < hi) if closed == "left" else (c <= hi))
        out = out.when(cond, F.lit(label))
    return out


# The age bands in use.
AGE_BANDS_STRUCTURE = ([None, 25, 35, 45, 55, None], ["<25", "25-34", "35-44", "45-54", "55+"])
AGE_BANDS_AB = ([0, 25, 35, 45, 55, 100], ["<25", "25-35", "35-45", "45-55", "55+"])
AGE_BANDS_LOCK = (
    [None, 25, 30, 35, 40, 45, 50, 55, None],
    ["<25", "25-29", "30-34", "35-39", "40-44", "45-49", "50-54", "55+"],
)


def age_band(col: str | Column, variant: str) -> Column:
    """The four banding variants: structure, ab, segments (right-closed) and lock (five years)."""
    c = as_col(col)
    if variant == "structure":
        return bucket(c, *AGE_BANDS_STRUCTURE, null_label="unknown")
    if variant == "ab":
        return bucket(c, *AGE_BANDS_AB)
    if variant == "segments":
        return bucket(c, *AGE_BANDS_AB, closed="right")
    if variant == "lock":
        return bucket(F.floor(c), *AGE_BANDS_LOCK, null_label="unknown")
    raise ValueError(f"unknown age band variant {variant!r}")


def norm_key(c: str | Column) -> Column:
    """Letters and digits only, lower case: the key groups are matched on."""
    return F.lower(F.regexp_replace(as_col(c), r"[^\p{L}\p{N}]", ""))
