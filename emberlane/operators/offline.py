"""Fits from cached series: stamps of any cadence instead of hourly statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..thresholds import HeatLoss, HotWater, Meter
from . import heatloss, hotwater, meters
from .alignment import interpolated
from .daily import hourly_over_all
from .meters import Zone, day_hours, local_time
from .quality import cadence


def zone_heat_kwh(zones: DataFrame, output_kw: float, by: list[str], tz: Zone) -> DataFrame:
    """(by, d, q): a day's heat by the mean percentage over zones at each stamp,
    as a share of what the boiler gives in 24 hours."""
    stamps = zones.groupBy(*by, "sec").agg(F.avg("value").alias("pct"))
    days = stamps.groupBy(*by, local_time(F.col("sec"), tz).cast("date").alias("d"))
    return days.agg((F.avg(F.col("pct") / 100 * output_kw) * 24).alias("q"))


def meter_heat_kwh(readings: DataFrame, by: list[str], tz: Zone, meter: Meter = Meter()) -> DataFrame:
    """(by, d, q) of complete days of a cumulative meter."""
    days = meters.daily(meters.steps(readings, by, meter), by, tz, meter)
    return days.where("complete").select(*by, "d", F.col("total").alias("q"))


def daily_delta_t(readings: DataFrame, rooms: list[str], outdoor: str, by: list[str], tz: Zone, coverage: float = 0.9) -> DataFrame:
    """(by, d, delta_t, rows): mean of all rooms less outdoors, at stamps at which
    every room reports. One missing outdoor stamp is filled on a line. Days hold
    ``coverage`` of what the series' own cadence, its median gap, lets expect."""
    inside = hourly_over_all(readings, rooms, by, F.avg("value"))
    out = readings.where(F.col("series_id") == outdoor).select(*by, "sec", F.col("value").alias("out"))
    aligned = interpolated(inside.join(out, [*by, "sec"], "left"), by, 1, "out")
    rows = aligned.where("out is not null and value is not null").select(*by, "sec", (F.col("value") - F.col("out")).alias("delta_t"))
    gaps = cadence(rows, by)
    days = rows.groupBy(*by, local_time(F.col("sec"), tz).cast("date").alias("d")).agg(F.avg("delta_t").alias("delta_t"), F.count("delta_t").alias("rows"))
    days = days.join(gaps, by, "left") if by else days.crossJoin(gaps)  # one row
    expected = day_hours(F.col("d"), tz) * 3600 / F.coalesce("cadence_s", F.lit(3600)) * coverage
    return days.where(F.col("rows") >= expected).select(*by, "d", "delta_t", "rows")


def fit_or_note(points: DataFrame, by: list[str], rule: HeatLoss = HeatLoss()) -> DataFrame:
    """The fit of days (by, d, delta_t, y) with its values only where every gate
    lets it pass, and a note on the others."""
    fits = heatloss.fit(points, by, rule)
    passed = F.col("rejection_reason").isNull()
    note = F.concat(F.lit("no result: "), F.col("rejection_reason"))  # null where nothing is rejected
    values = [F.when(passed, F.col(c)).alias(c) for c in ("hlc", "ci_low", "ci_high", "intercept", "r1", "effective_days")]
    return fits.select(*by, F.col("n").alias("days"), *values, "r2", note.alias("note"))


def fit_joined(heat: DataFrame, delta_t: DataFrame, by: list[str], rule: HeatLoss = HeatLoss()) -> DataFrame:
    """``fit_or_note`` of days that have both heat (q) and delta_t."""
    return fit_or_note(heatloss.fit_points(heat.join(delta_t, [*by, "d"]), rule), by, rule)


def corrected_fit(days: DataFrame, by: list[str], rule: HeatLoss = HeatLoss(), water: HotWater = HotWater()) -> DataFrame:
    """The fit after the mains-scaled hot-water baseline is taken off, for days
    (by, d, q, delta_t, outdoor); mild days make the baseline. What is left has to
    pass the energy gate again. Homes without a baseline or with a note have no row."""
    mild = days.select(*by, "d", "q", "delta_t", "outdoor", F.lit(None).cast("double").alias("water"), (F.col("delta_t") < water.off_delta_t).alias("off"))
    base = hotwater.baseline(mild, by, water).where("status <> 'invalid'").select(*by, "baseline", "reference_c")
    scaled: Column = hotwater.scaled_kwh(F.col("baseline"), F.col("outdoor"), F.col("reference_c"), water)
    rows = days.join(base, by).withColumn("hot_kwh", scaled)
    points = heatloss.fit_points(rows, rule, hot_water="hot_kwh").where(F.col("y") > rule.min_energy)
    fits = fit_or_note(points, by, rule)
    return fits.where("note is null").drop("note").join(base.select(*by, "baseline"), by)
