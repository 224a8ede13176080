"""Lag tests on daily series: regressions from sums of lagged products, and unit-root tests per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F >= f) with d1 and d2 degrees of freedom."""
    return 1.0 if f <= 0 else beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_tail(x: float, k: float) -> float:
    """P(chi-square >= x) with k degrees of freedom: upper incomplete gamma."""
    if x <= 0:
        return 1.0
    a, z = k / 2, x / 2
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= z / n
            total += term
        return 1 - total * scale
    tiny, b = 1e-300, z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b) if abs(num * d + b) > tiny else 1 / tiny
        c = b + num / c if abs(b + num / c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    return beta, float(resid @ resid)


def _eliminated(a: Column, size: Column, first: Column, last: Column, diagonal: Column) -> Column:
    """A flattened square matrix of sums of products after elimination of the variables first..last.

    What is left of the last variable's own sum is the squared error of its regression on those before. A variable that
    the ones before it determine is passed over.
    """

    def step(acc: Column, p: Column) -> Column:
        pivot = F.get(acc, p * size + p)
        solid = pivot > F.get(diagonal, p * size + p) * F.lit(1e-10)

        def cell(v: Column, at: Column) -> Column:
            row, column = F.floor(at / size).cast("int"), (at % size).cast("int")
            return F.when(solid, v - F.get(acc, row * size + p) * F.get(acc, p * size + column) / pivot).otherwise(v)

        return F.transform(acc, cell)

    return F.aggregate(F.sequence(first, last), a, step)


def _tails(f: pd.Series, chi: pd.Series, lag: pd.Series, dof: pd.Series) -> pd.DataFrame:
    rows = [(f_tail(a, k, d), chi2_tail(b, k)) if a == a and a is not None else (None, None) for a, b, k, d in zip(f, chi, lag, dof)]
    return pd.DataFrame(rows, columns=["p_f", "p_chi2"])


def granger(series: DataFrame, max_lag: int = 7, drop_joint_zeros: bool = True) -> DataFrame:
    """Does x help predict y? F and chi-square tests per group and lag 1..max_lag.

    series: (grp, date, x, y). Lags without enough days, or fitted without error, give null tests. Dropping days
    where both are 0 shortens calendar gaps; switch it off to keep true calendar lags.

    Each day gives the products of the lagged values, which are summed per (group, lag); the two regressions of a
    lag are one elimination of its sums, own lags first. No series is held as a whole.
    """
    days = series.select("grp", "date", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if drop_joint_zeros:
        days = days.where((F.col("x") != 0) | (F.col("y") != 0))
    group = Window.partitionBy("grp")
    order = group.orderBy("date")
    # distances from the mean change no test and keep the digits
    days = days.select("grp", "date", *[(F.col(c) - F.avg(c).over(group)).alias(c) for c in ("x", "y")])
    lagged = days.select(
        "grp",
        (F.row_number().over(order) - 1).alias("_t"),
        F.array(*[F.lag("y", k).over(order) for k in range(max_lag + 1)]).alias("_y"),
        F.array(*[F.lag("x", k).over(order) for k in range(1, max_lag + 1)]).alias("_x"),
    )
    lags = F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag")
    each = lagged.select("*", lags).where(F.col("_t") >= F.col("lag"))
    z = F.concat(F.array(F.lit(1.0)), F.slice("_y", F.lit(2), F.col("lag")), F.slice("_x", F.lit(1), F.col("lag")), F.slice("_y", 1, 1))
    products = F.flatten(F.transform("_z", lambda a: F.transform("_z", lambda b: a * b)))
    cells = each.select("grp", "lag", z.alias("_z")).select("grp", "lag", F.posexplode(products).alias("_at", "_p"))
    sums = cells.groupBy("grp", "lag", "_at").agg(F.sum("_p").alias("_s")).groupBy("grp", "lag").agg(F.array_sort(F.collect_list(F.struct("_at", "_s"))).alias("_m"))
    lag, size = F.col("lag"), F.col("lag") * 2 + 2
    own = _eliminated(F.col("_a"), size, F.lit(0), lag, F.col("_a"))
    both = _eliminated(F.col("_own"), size, lag + 1, lag * 2, F.col("_a"))
    end = size * size - 1
    fitted = sums.select("grp", "lag", F.transform("_m", lambda c: c["_s"]).alias("_a")).withColumn("_own", own).withColumn("_all", both)
    # an empty group of a lag has no sums but is in the result
    counts = days.groupBy("grp").agg(F.count("*").alias("_days")).select("grp", "_days", lags)
    errors = fitted.select("grp", "lag", F.get("_a", F.lit(0)).alias("_n"), F.get("_a", end).alias("_total"), F.get("_own", end).alias("_so"), F.get("_all", end).alias("_sa"))
    rows = counts.join(errors, ["grp", "lag"], "left")
    dof = F.col("_n") - lag * 2 - 1
    gain = F.greatest(F.col("_so") - F.col("_sa"), F.lit(0.0))
    valid = (dof > 0) & (F.col("_sa") > F.greatest(F.col("_total"), F.lit(1.0)) * F.lit(1e-12))
    f = F.when(valid, gain / F.col("_sa") / lag * dof)
    chi = F.when(valid, F.col("_n") * gain / F.col("_sa"))
    tested = rows.select("grp", "lag", F.greatest(F.col("_days") - lag, F.lit(0)).cast("int").alias("n"), f.alias("f_stat"), F.pandas_udf(_tails, "p_f double, p_chi2 double")(f, chi, lag, dof).alias("_p"))
    return tested.select("grp", "lag", "n", "f_stat", "_p.p_f", "_p.p_chi2")


def best_lag(tests: DataFrame, lo: int = 1, hi: int = 3) -> DataFrame:
    """Lag in lo..hi with the least p of the F test per group, the smaller lag on a tie."""
    key = F.when(F.col("p_f").isNotNull(), F.struct("p_f", "lag"))
    best = tests.where(F.col("lag").between(lo, hi)).groupBy("grp").agg(F.min(key).alias("b"))
    return best.select("grp", F.col("b.lag").alias("lag"), F.col("b.p_f").alias("p_f"), (F.col("b.p_f") < 0.05).alias("significant"))


# Published response-surface coefficients of the unit-root test with a constant.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
TAU_SMALL_P = (2.1659, 1.4412, 0.038269)
TAU_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(tau: float) -> float:
    """Approximate p-value of the unit-root statistic."""
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    coef = TAU_SMALL_P if tau <= TAU_STAR else TAU_LARGE_P
    z = sum(c * tau**i for i, c in enumerate(coef))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def unit_root(v: np.ndarray, lags: int | None = None) -> tuple[float | None, float | None, int | None]:
    """Augmented unit-root regression with a constant; the lag order is chosen by AIC unless given."""
    if len(v) < 3 or len(np.unique(v)) <= 1:
        return None, None, None
    n = len(v)
    max_lag = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if max_lag < 0:
        return None, None, None
    diff = np.diff(v)

    def design(k: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(diff) - k
        cols = [v[-m - 1 : -1]] + [diff[k - j : len(diff) - j] for j in range(1, k + 1)]
        return diff[k:], np.column_stack(cols)

    y_all, x_all = design(max_lag)
    best, order = None, 0
    for k in range(max_lag + 1) if lags is None else ():
        x = np.hstack([np.ones((len(y_all), 1)), x_all[:, : k + 1]])
        _, ssr = _ols(y_all, x)
        m = len(y_all)
        if ssr <= 0:
            continue
        aic = m * (math.log(2 * math.pi) + math.log(ssr / m) + 1) + 2 * (k + 2)
        if best is None or aic < best:
            best, order = aic, k
    order = order if lags is None else min(lags, max_lag)
    y, x = design(order)
    x = np.hstack([x, np.ones((len(y), 1))])
    dof = len(y) - x.shape[1]
    if dof <= 0:
        return None, None, None
    beta, ssr = _ols(y, x)
    spread = ssr / dof * np.linalg.pinv(x.T @ x)[0, 0]
    if spread <= 0:
        return None, None, None
    tau = float(beta[0] / math.sqrt(spread))
    return tau, unit_root_p(tau), order


def adf(series: DataFrame, cols: tuple[str, ...] = ("x", "y"), lags: int | None = None) -> DataFrame:
    """Unit-root statistic and p per group and series column, with the lag order chosen by AIC or as given."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        rows = [(pdf["grp"].iloc[0], c, *unit_root(pdf[c].to_numpy(float), lags)) for c in cols]
        return pd.DataFrame(rows, columns=["grp", "series", "stat", "p", "lags"])

    return series.groupBy("grp").applyInPandas(run, "grp string, series string, stat double, p double, lags int")
