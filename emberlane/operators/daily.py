"""Daily rollups of measurements, and heating-off days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..thresholds import HotWater
from .chunks import CHUNK, CHUNK_S, along, chunked, inside
from .meters import Zone, local_time


def daily_mean(readings: DataFrame, by: list[str], tz: Zone) -> DataFrame:
    return readings.groupBy(*by, local_time(F.col("sec"), tz).cast("date").alias("d")).agg(F.avg("value").alias("value"), F.count("value").alias("hours"))


def hourly_over_all(readings: DataFrame, members: list[str], by: list[str], of: Column, name: str = "series_id") -> DataFrame:
    """(by, sec, value): ``of`` over the members in hours in which all report."""
    met = readings.where(F.col(name).isin(members)).groupBy(*by, "sec").agg(F.countDistinct(name).alias("n"), of.alias("value"))
    return met.where(F.col("n") == len(members)).drop("n")


def hourly_over_any(readings: DataFrame, members: list[str], by: list[str], name: str = "series_id") -> DataFrame:
    return readings.where(F.col(name).isin(members)).groupBy(*by, "sec").agg(F.avg("value").alias("value"))


def daily_delta_t(readings: DataFrame, rooms: list[str], outdoor: str, by: list[str], tz: Zone, min_hours: int = 18) -> DataFrame:
    """(by, d, delta_t, hours): mean room temperature less outdoors, over hours in
    which every room and the outdoor sensor report; days of ``min_hours`` or more."""
    inside = hourly_over_all(readings, rooms, by, F.avg("value"))
    out = readings.where(F.col("series_id") == outdoor).select(*by, "sec", F.col("value").alias("outdoor"))
    hours = inside.join(out, [*by, "sec"]).withColumn("value", F.col("value") - F.col("outdoor"))
    days = daily_mean(hours, by, tz)
    return days.where(F.col("hours") >= min_hours).select(*by, "d", F.col("value").alias("delta_t"), "hours")


def daily_busiest(readings: DataFrame, sensors: list[str], by: list[str], tz: Zone, min_hours: int = 18) -> DataFrame:
    """(by, d, heat_pct, hours): daily mean of the hourly maximum over sensors."""
    days = daily_mean(hourly_over_all(readings, sensors, by, F.max("value")), by, tz)
    return days.where(F.col("hours") >= min_hours).select(*by, "d", F.col("value").alias("heat_pct"), "hours")


def heating_off(delta_t: DataFrame, heat_pct: DataFrame, by: list[str], rule: HotWater = HotWater()) -> DataFrame:
    """(by, d, off): by measured heating where there is any, else by a small delta_t."""
    both = delta_t.join(heat_pct, [*by, "d"], "full")
    off = F.when(F.col("heat_pct").isNotNull(), F.col("heat_pct") <= rule.off_heat_pct).otherwise(F.col("delta_t") < rule.off_delta_t)
    return both.select(*by, "d", F.coalesce(off, F.lit(False)).alias("off"))


def drop_flatlines(readings: DataFrame, by: list[str], rows: int = 24, span: float = 0.05, chunk_s: int = CHUNK_S) -> DataFrame:
    """Without readings whose last ``rows`` readings, themselves included, vary
    by less than ``span``; dropped ones still count as readings.

    A chunk starts with the last ``rows`` - 1 readings before it, which are the
    ends of so many chunks at most.
    """
    reading = F.struct("sec", "value")
    newest = lambda c, n: F.slice(F.reverse(F.array_sort(c)), 1, n)
    placed = chunked(readings, chunk_s)
    ends = placed.groupBy(*by, CHUNK).agg(newest(F.collect_list(reading), rows - 1).alias("end"))  # a chunk's rows
    before = F.collect_list("end").over(along(by).rowsBetween(-(rows - 1), -1))
    tails = ends.select(*by, CHUNK, before.alias("__e")).select(*by, CHUNK, F.inline(newest(F.flatten("__e"), rows - 1)))
    both = placed.withColumn("__own", F.lit(True)).unionByName(tails.withColumn("__own", F.lit(False)), allowMissingColumns=True)
    frame = inside(by).rowsBetween(-(rows - 1), 0)
    marked = both.withColumns({"__n": F.count("value").over(frame), "__s": F.max("value").over(frame) - F.min("value").over(frame)})
    return marked.where(F.col("__own") & ~((F.col("__n") == rows) & (F.col("__s") < span))).select(readings.columns)
