"""Electricity and water use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def electricity(days: DataFrame, by: list[str], window: int = 30, min_days: int = 14) -> DataFrame:
    """(by, days, kwh_per_day, historical, baseload_w, share_pct) over the last
    ``window`` days; ``days`` has total and least (hourly minimum)."""
    marked = days.withColumn("age", F.datediff(F.max("d").over(Window.partitionBy(*by)), "d"))
    now = lambda c: F.when(F.col("age") < window, F.col(c))
    out = marked.groupBy(*by).agg(
        F.count(now("total")).alias("days"), F.avg(now("total")).alias("kwh_per_day"), F.avg("total").alias("historical"), F.median(now("least")).alias("base"),
    )
    share = F.least(F.lit(100.0), F.try_divide(F.col("base") * 24, F.col("kwh_per_day")) * 100)
    return out.select(*by, "days", "kwh_per_day", "historical", (F.col("base") * 1000).alias("baseload_w"), share.alias("share_pct"), (F.col("days") >= min_days).alias("usable"))


#: Pounds for a kWh of 1 in these units.
TARIFF_UNITS = [(1.0, ("gbp/kwh", "£/kwh")), (0.01, ("p/kwh", "pence/kwh")), (0.001, ("gbp/mwh", "£/mwh"))]


def tariff_per_kwh(value: Column, unit: Column) -> Column:
    """Pounds for a kWh; null for other units, text and negative numbers."""
    number = value.try_cast("double")
    clean = F.lower(F.replace(unit, F.lit(" "), F.lit("")))
    scaled = F.coalesce(*(F.when(clean.isin(*names), number * factor) for factor, names in TARIFF_UNITS))
    return F.when((scaled >= 0) & ~F.isnan(scaled) & (scaled < float("inf")), scaled)
