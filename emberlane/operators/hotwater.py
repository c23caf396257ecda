"""Hot water: baseline, rate by litres, attribution and use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import lower_quartile, ols, upper_quartile
from ..thresholds import BOILER_EFFICIENCY, HotWater


def mains_c(outdoor: Column, rule: HotWater = HotWater()) -> Column:
    """Temperature of mains water: linear between its bounds."""
    (low, high), (cold, warm) = rule.mains_c, rule.outdoor_c
    share = (outdoor - cold) / (warm - cold)
    return low + (high - low) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def scaled_kwh(baseline: Column, outdoor: Column, reference: Column, rule: HotWater = HotWater()) -> Column:
    return baseline * (rule.tank_c - mains_c(outdoor, rule)) / (rule.tank_c - mains_c(reference, rule))


def litres_kwh(litres: Column, rate: Column, outdoor: Column, rule: HotWater = HotWater()) -> Column:
    return litres * rate * (rule.tank_c - mains_c(outdoor, rule)) / 1000


def baseline(days: DataFrame, by: list[str], rule: HotWater = HotWater()) -> DataFrame:
    """(by, baseline, reference_c, days_used, away_days, idle_kwh, status) from
    heating-off days (column off) with gas q and outdoor; away days, on which
    less than ``away_litres`` ran, are left out and give the idle use."""
    off = days.where(F.col("off") & F.col("q").isNotNull() & F.col("outdoor").isNotNull())
    away = F.coalesce(F.col("water") < rule.away_litres, F.lit(False))
    home = lambda c: F.when(~away, F.col(c))
    found = off.groupBy(*by).agg(
        F.median(home("q")).alias("baseline"), F.avg(home("outdoor")).alias("reference_c"), F.count_if(~away).alias("days_used"),
        F.count_if(away).alias("away_days"), F.median(F.when(away, F.col("q"))).alias("idle_kwh"),
    )
    enough = F.col("days_used") >= rule.min_days
    return found.withColumns(
        {
            "idle_kwh": F.when(F.col("away_days") >= rule.min_away_days, F.col("idle_kwh")),
            "status": F.when(~enough, "invalid").when(F.col("days_used") >= rule.valid_days, "valid").otherwise("provisional"),
        }
    )


def water_rate(days: DataFrame, by: list[str], rule: HotWater = HotWater(), limit: str | None = None) -> DataFrame:
    """(by, rate, rate_days, rate_iqr, usable): Wh for a litre and a kelvin, from
    heating-off days with litres between ``away_litres`` and column ``limit``."""
    litres = F.col("water") >= rule.away_litres
    if limit:
        litres = litres & (F.col("water") <= F.coalesce(F.col(limit), F.col("water")))
    used = days.where(F.col("off") & (F.col("q") > 0) & litres & F.col("outdoor").isNotNull())
    rates = used.withColumn("r", F.col("q") * 1000 / F.col("water") / (rule.tank_c - mains_c(F.col("outdoor"), rule)))
    found = rates.groupBy(*by).agg(F.median("r").alias("rate"), F.count("r").alias("rate_days"), (upper_quartile("r") - lower_quartile("r")).alias("rate_iqr"))
    return found.withColumn("usable", (F.col("rate_days") >= rule.min_rate_days) & F.col("rate").between(*rule.rate_bounds))


def outlier_limit(days: DataFrame, by: list[str], window: int = 30, min_days: int = 5) -> DataFrame:
    """(by, limit): three medians or the upper quartile and three interquartile
    ranges, whichever is more, over the last ``window`` days with water."""
    wet = days.where(F.col("water").isNotNull())
    recent = wet.withColumn("__last", F.max("d").over(Window.partitionBy(*by))).where(F.datediff("__last", "d") < window)
    q1, q3 = lower_quartile("water"), upper_quartile("water")
    limit = F.greatest(3 * F.median("water"), q3 + 3 * (q3 - q1))
    return recent.groupBy(*by).agg(F.when(F.count("water") >= min_days, limit).alias("limit"))


def attribute(days: DataFrame, rule: HotWater = HotWater()) -> DataFrame:
    """Adds hot_kwh, how and outlier to days with off, q, outdoor, water and the
    home's baseline, reference_c, rate (null if unusable) and limit.

    A day without heating is all hot water; else litres tell, unless they are
    an outlier; else the baseline scaled by the mains; never more than q. Days
    without outdoor temperature stay without. Every heating day with more litres
    than the limit counts as outlier, whether or not a rate is known.
    """
    metered = F.col("rate").isNotNull() & F.col("water").isNotNull() & F.col("outdoor").isNotNull()
    outlier = F.coalesce(F.col("water") > F.col("limit"), F.lit(False))
    by_litres = F.least(litres_kwh(F.col("water"), F.col("rate"), F.col("outdoor"), rule), F.col("q"))
    by_mains = F.least(scaled_kwh(F.col("baseline"), F.col("outdoor"), F.col("reference_c"), rule), F.col("q"))
    pick = lambda a, b, c: F.when(F.col("off"), a).when(metered & ~outlier, b).when(F.col("outdoor").isNotNull() & F.col("baseline").isNotNull(), c)
    return days.withColumns(
        {"hot_kwh": pick(F.col("q"), by_litres, by_mains), "how": pick(F.lit("off"), F.lit("litres"), F.lit("mains")), "outlier": ~F.col("off") & outlier}
    )


def gas_water(gas: DataFrame, water: DataFrame, by: list[str], min_hours: int = 200, min_r2: float = 0.5, ideal_wh: float = 34.8, min_distinct: int = 10, efficiency: Column | float = BOILER_EFFICIENCY) -> DataFrame:
    """Hourly regression of gas steps on water steps at the same stamps. Fewer
    than ``min_distinct`` different water steps make it unusable. hot_pct is the
    heat delivered for a litre against what a hot one takes (``ideal_wh``)."""
    both = gas.select(*by, "sec", F.col("step").alias("gas")).join(water.select(*by, "sec", F.col("step").alias("litres")), [*by, "sec"])
    lines = both.groupBy(*by).agg(*ols("gas", "litres"), F.countDistinct("litres").alias("distinct_litres"))
    usable = (F.col("n") >= min_hours) & (F.col("distinct_litres") >= min_distinct) & (F.col("slope") > 0) & (F.col("r2") >= min_r2)
    return lines.withColumns({"wh_per_litre": F.col("slope") * 1000, "hot_pct": F.least(F.lit(100.0), F.col("slope") * 1000 * efficiency / ideal_wh * 100), "usable": usable})
