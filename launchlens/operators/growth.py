"""Growth of a presale's running orders: phases, fits and forecast.

Input curves have one row per group and day (grp, day, daily_orders, cumulative_orders).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from launchlens.functions.semantics import ratio

# Day ratios that bound the phases.
SURGE_END, PLATEAU_START, PLATEAU_END = 0.107, 0.179, 0.750
# Day ratios the phase polynomials are fitted on, and their degrees.
FIT_PLATEAU_END = 0.714
DEGREES = {"initial": 2, "plateau": 2, "final": 3}
# Forecast thresholds as shares of the target day.
T_INITIAL, T_PLATEAU, T_ACCEL, T_SURGE = 0.536, 0.750, 0.786, 0.929
REFERENCE_DAYS = 28


@dataclass(frozen=True)
class ForecastRule:
    """Fixed values of the forecast: how the end of a presale speeds up, and how each target day past REFERENCE_DAYS adds to it."""

    #: daily orders where neither a fit nor a recent gain speaks for a day: in the last phase, and before it
    late_pace: float = 800.0
    early_pace: float = 500.0
    #: pace from T_SURGE on: base, rise per share of the target, and what a day past the reference adds to the rise
    surge_base: float = 2.0
    surge_rise: float = 12.0
    surge_per_day: float = 0.1
    #: pace from T_ACCEL on: its rise, lowered per day past the reference down to a least value
    ramp_drop: float = 0.02
    ramp_least: float = 0.5
    #: factor of the recent pace, and what a day past the reference adds to it and to the early pace
    pace_factor: float = 1.2
    pace_per_day: float = 0.05
    #: height of the S-curve per day past the reference
    height_per_day: float = 0.1
    #: growth of the recent gain per day ahead, and per day past the reference
    gain_per_day: float = 0.05
    gain_rise: float = 0.03


def growth_phases(curve: DataFrame) -> DataFrame:
    """Phase of each day by day / last day; the gap between surge and plateau counts as final."""
    last = F.max("day").over(Window.partitionBy("grp"))
    share = F.col("day") / last
    phase = F.when(share <= SURGE_END, "initial_surge").when(share.between(PLATEAU_START, PLATEAU_END), "plateau").otherwise("final_surge")
    return curve.select("grp", "day", phase.alias("phase"))


def growth_tail(curve: DataFrame, from_ratio: float = 0.5) -> DataFrame:
    """Mean daily growth, mean acceleration and largest growth past a share of the days."""
    w = Window.partitionBy("grp").orderBy("day")
    last = F.max("day").over(Window.partitionBy("grp"))
    tail = curve.withColumn("_last", last).where(F.col("day") >= F.floor(F.col("_last") * from_ratio))
    grown = tail.withColumn("_g", F.col("cumulative_orders") - F.lag("cumulative_orders").over(w))
    speed = grown.withColumn("_a", F.col("_g") - F.lag("_g").over(w))
    return speed.groupBy("grp").agg(
        F.count("*").alias("days"), F.avg("_g").alias("avg_daily_growth"), F.avg("_a").alias("growth_acceleration"), F.max("_g").alias("max_daily_growth")
    ).where(F.col("days") > 2)


def s_curve(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """L / (1 + exp(-k (x - m))) + b."""
    return p[0] / (1 + np.exp(np.clip(-p[1] * (x - p[2]), -60, 60))) + p[3]


def fit_s_curve(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Damped Gauss-Newton inside bounds taken from the data's range."""
    top, low, days = y.max(), y.min(), x.max()
    lower = np.array([top * 0.9, 0.1, days * 0.5, 0.0])
    upper = np.array([top * 1.5, 0.5, days * 0.9, max(low, 1e-9)])
    p = np.clip(np.array([top * 1.15, 0.25, days * 0.75, low * 0.8]), lower, upper)
    damp, cost = 1e-3, float(np.sum((s_curve(x, p) - y) ** 2))
    for _ in range(rounds):
        e = 1 / (1 + np.exp(np.clip(-p[1] * (x - p[2]), -60, 60)))
        slope = p[0] * e * (1 - e)
        jac = np.column_stack([e, slope * (x - p[2]), -slope * p[1], np.ones_like(x)])
        resid = y - s_curve(x, p)
        normal = jac.T @ jac
        step = np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-12), jac.T @ resid, rcond=None)[0]
        trial = np.clip(p + step, lower, upper)
        trial_cost = float(np.sum((s_curve(x, trial) - y) ** 2))
        if trial_cost < cost:
            done = cost - trial_cost < 1e-12 * max(cost, 1.0)
            p, cost, damp = trial, trial_cost, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p


def fit_poly(x: np.ndarray, y: np.ndarray, degree: int) -> np.ndarray:
    """Least squares with intercept; with too few points the smallest coefficients."""
    powers = np.column_stack([x**k for k in range(1, degree + 1)])
    mean = powers.mean(axis=0)
    coef = np.linalg.lstsq(powers - mean, y - y.mean(), rcond=None)[0]
    return np.concatenate([[y.mean() - mean @ coef], coef])


FIT_SCHEMA = "grp string, model string, points int, c0 double, c1 double, c2 double, c3 double, rmse double"


def growth_fit(curve: DataFrame) -> DataFrame:
    """Per group: polynomials for the three phases (where there are points enough) and an S-curve over all days.

    Coefficients c0..c3 rise in power; for the S-curve they are height, rate, midpoint, base.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        x, y = pdf["day"].to_numpy(float), pdf["cumulative_orders"].to_numpy(float)
        last, rows = x.max(), []
        masks = {
            "initial": (x <= int(last * SURGE_END), 1),
            "plateau": ((x >= int(last * PLATEAU_START)) & (x <= int(last * FIT_PLATEAU_END)), 2),
            "final": (x >= int(last * FIT_PLATEAU_END), 1),
        }
        for name, (mask, least) in masks.items():
            if mask.sum() > least:
                c = fit_poly(x[mask], y[mask], DEGREES[name])
                fitted = sum(v * x[mask] ** k for k, v in enumerate(c))
                c = np.concatenate([c, np.zeros(4 - len(c))])
                rows.append((pdf["grp"].iloc[0], name, int(mask.sum()), *c, float(np.sqrt(np.mean((fitted - y[mask]) ** 2)))))
        if len(x) >= 4:
            p = fit_s_curve(x, y)
            rows.append((pdf["grp"].iloc[0], "s_curve", len(x), *p, float(np.sqrt(np.mean((s_curve(x, p) - y) ** 2)))))
        return pd.DataFrame(rows, columns=["grp", "model", "points", "c0", "c1", "c2", "c3", "rmse"])

    return curve.select("grp", "day", "cumulative_orders").groupBy("grp").applyInPandas(run, FIT_SCHEMA)


def growth_forecast(curve: DataFrame, fit: DataFrame, target: int, recent: int = 6, rule: ForecastRule = ForecastRule()) -> DataFrame:
    """Running orders of every group for the days after its last one up to `target`.

    Which model speaks for a day depends on its share of the target; past the
    acceleration threshold the recent daily mean is scaled up. Never below the last
    actual value. Also gives daily increments and growth over the last actual.
    """
    newest = F.row_number().over(Window.partitionBy("grp").orderBy(F.col("day").desc()))
    gain = F.col("cumulative_orders") - F.lag("cumulative_orders").over(Window.partitionBy("grp").orderBy("day"))
    seen = curve.withColumn("_gain", gain).withColumn("_rn", newest).groupBy("grp").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("day"))).alias("last_day"),
        F.max(F.when(F.col("_rn") == 1, F.col("cumulative_orders"))).cast("double").alias("last_actual"),
        F.avg(F.when(F.col("_rn") <= recent, F.col("daily_orders"))).alias("pace"),
        F.avg(F.when(F.col("_rn") <= 2, F.col("_gain"))).alias("last_gain"),
    )
    models = ("initial", "plateau", "final", "s_curve")
    params = fit.groupBy("grp").agg(
        *[F.max(F.when(F.col("model") == m, F.col(f"c{k}"))).alias(f"{m}_{k}") for m in models for k in range(4)]
    )
    days = seen.where(F.col("last_day") < target).join(params, "grp", "left").withColumn(
        "day", F.explode(F.sequence(F.col("last_day") + 1, F.lit(target)))
    )
    x = F.col("day").cast("double")
    poly = lambda m: sum((F.col(f"{m}_{k}") * F.pow(x, F.lit(k)) for k in range(1, 4)), F.col(f"{m}_0"))
    over = target - REFERENCE_DAYS
    initial_end, plateau_end, accel = int(target * T_INITIAL), int(target * T_PLATEAU), int(target * T_ACCEL)
    share = x / target
    surge = rule.surge_base + (share - T_SURGE) * rule.surge_rise * (1.0 + over * rule.surge_per_day)
    ramp = 1.0 + (share - T_ACCEL) / (T_SURGE - T_ACCEL) * max(rule.ramp_least, 1.0 - over * rule.ramp_drop)
    factor = F.when(share >= T_SURGE, surge).when(share >= T_ACCEL, ramp).otherwise(1.0)
    beyond = x - F.col("last_day")
    scaled = F.col("last_actual") + F.col("pace") * beyond * factor * (rule.pace_factor * (1.0 + over * rule.pace_per_day))
    curve_value = F.col("s_curve_0") * (1.0 + over * rule.height_per_day) / (1 + F.exp(-F.col("s_curve_1") * (x - F.col("s_curve_2")))) + F.col("s_curve_3")
    trend = F.col("last_actual") + beyond * F.coalesce("last_gain", F.lit(rule.late_pace)) * (1.0 + beyond * rule.gain_per_day * (1.0 + over * rule.gain_rise))
    flat = F.col("last_actual") + beyond * (rule.early_pace * (1.0 + over * rule.pace_per_day))
    has = lambda m: F.col(f"{m}_0").isNotNull()
    d = F.col("day")
    predicted = (
        F.when((d <= initial_end) & has("initial"), poly("initial"))
        .when((d <= plateau_end) & has("plateau"), poly("plateau"))
        .when((d >= plateau_end) & (d <= accel) & has("final"), poly("final"))
        .when(d > accel, scaled)
        .when(d >= plateau_end, F.coalesce(curve_value, trend))
        .otherwise(F.coalesce(curve_value, flat))
    )
    rows = days.select("grp", "day", "last_actual", F.greatest(predicted, F.col("last_actual")).alias("cumulative_orders"))
    before = F.lag("cumulative_orders").over(Window.partitionBy("grp").orderBy("day"))
    growth = F.col("cumulative_orders") - F.col("last_actual")
    return rows.select(
        "grp", "day", "cumulative_orders",
        (F.col("cumulative_orders") - F.coalesce(before, F.col("last_actual"))).alias("daily_orders"),
        growth.alias("growth"), (ratio(growth, F.col("last_actual"), None) * 100).alias("growth_pct"),
    )
