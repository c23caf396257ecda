"""Heat-loss coefficient: daily regression with autocorrelation-aware limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import lag1_autocorrelation, ols, variance_inflation
from ..thresholds import HeatLoss


def fit_points(days: DataFrame, rule: HeatLoss = HeatLoss(), energy: str = "q", delta_t: str = "delta_t", hot_water: str | None = None) -> DataFrame:
    """Days that enter the fit, with column y: the raw energy passes the gate,
    hot water is taken off (0 where unknown), and what is left is positive."""
    used = days.where((F.col(energy) > rule.min_energy) & (F.col(delta_t) > rule.min_delta_t))
    rest = F.col(energy) - (F.coalesce(F.col(hot_water), F.lit(0.0)) if hot_water else 0.0)
    return used.withColumn("y", rest).where("y > 0")


def fit(points: DataFrame, by: list[str], rule: HeatLoss = HeatLoss(), delta_t: str = "delta_t") -> DataFrame:
    """One row for each home: the fit, its limits, status and rejection_reason.

    Values are given also where a gate rejects them.
    """
    lines = points.groupBy(*by).agg(*ols("y", delta_t))
    residuals = points.join(lines.select(*by, "slope", "intercept"), by).withColumn("e", F.col("y") - F.col("intercept") - F.col("slope") * F.col(delta_t))
    memory = lag1_autocorrelation(residuals, by, "d", "e", rule.min_pairs)
    spread = residuals.groupBy(*by).agg(F.sum(F.col("e") * F.col("e")).alias("sse"))
    vif = variance_inflation(F.col("r1"), rule.max_lag1)
    watts = 1000 / 24
    error = F.sqrt(F.try_divide(F.try_divide(F.col("sse"), F.col("n") - 2), F.col("sxx"))) * F.sqrt(vif)
    out = lines.join(memory, by).join(spread, by).withColumns(
        {
            "hlc": F.col("slope") * watts,
            "effective_days": F.col("n") / vif,
            "ci_low": (F.col("slope") - rule.z * error) * watts,
            "ci_high": (F.col("slope") + rule.z * error) * watts,
            "free_gains_w": -F.col("intercept") * watts,
        }
    )
    reason = (
        F.when(F.col("n") < rule.min_days, "too few days")
        .when(F.col("x_spread") < rule.min_spread, "too little spread")
        .when(F.col("slope") <= 0, "slope isn't positive")
        .when(F.col("r2") < rule.min_r2, "weak fit")
        .when(~F.col("hlc").between(*rule.bounds), "out of bounds")
        .when(F.col("ci_low") <= 0, "limits include zero")
    )
    status = F.when(reason.isNotNull(), "invalid").when(F.col("n") >= rule.valid_days, "valid").otherwise("provisional")
    return out.withColumns({"rejection_reason": reason, "status": status})


def in_window(days: DataFrame, since, until=None, day: str = "d", include_end: bool = True) -> DataFrame:
    picked = days.where(F.col(day) >= since)
    if until is not None:
        picked = picked.where(F.col(day) <= until if include_end else F.col(day) < until)
    return picked


def first_sufficient(rows: DataFrame, by: list[str], windows: list[int], min_rows: int, day: str = "d") -> DataFrame:
    """(by, window_days, n): the shortest window before the last day with
    ``min_rows`` rows, else the longest. All windows are counted in one pass."""
    last = rows.groupBy(*by).agg(F.max(day).alias("last"))
    near = rows.join(last, by).withColumn("age", F.datediff("last", F.col(day)))
    counts = near.groupBy(*by).agg(*(F.count_if(F.col("age") <= w).alias(f"n{w}") for w in windows))
    pick = F.lit(windows[-1])
    n = F.col(f"n{windows[-1]}")
    for w in reversed(windows[:-1]):
        pick, n = F.when(F.col(f"n{w}") >= min_rows, w).otherwise(pick), F.when(F.col(f"n{w}") >= min_rows, F.col(f"n{w}")).otherwise(n)
    return counts.select(*by, pick.alias("window_days"), n.alias("n"))
