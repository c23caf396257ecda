"""Cumulative meters: gap-aware steps and complete local days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..thresholds import Meter
from .chunks import with_previous


def epoch_seconds(value: Column) -> Column:
    """Seconds of a stamp given in seconds or, beyond 1e12, milliseconds."""
    return F.floor(F.when(value > 1e12, value / 1000).otherwise(value)).cast("long")


#: A time zone: one name for all rows, or the column that holds each row's, such as its home's.
Zone = str | Column


def zone(tz: Zone) -> Column:
    return F.lit(tz) if isinstance(tz, str) else tz


def local_time(sec: Column, tz: Zone) -> Column:
    """Wall-clock time (without zone) of epoch seconds in ``tz``."""
    utc = F.timestamp_add("SECOND", sec, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), zone(tz), utc)


def day_hours(day: Column, tz: Zone) -> Column:
    """Hours of a local calendar day: 24, or 23 and 25 where clocks change."""
    start = lambda d: F.convert_timezone(zone(tz), F.lit("UTC"), d.cast("timestamp_ntz"))
    return F.timestamp_diff("HOUR", start(day), start(F.date_add(day, 1)))


def series(rows: DataFrame, kind: str, by: list[str], start: str = "start") -> DataFrame:
    """(by, sec, value) of statistics rows; null values go, the last row of a
    stamp (by ``seq``, if there) stays."""
    picked = rows.where(F.col(kind).isNotNull()).withColumn("sec", epoch_seconds(F.col(start)))
    order = F.col("seq") if "seq" in rows.columns else F.col(start)
    return picked.groupBy(*by, "sec").agg(F.max_by(kind, order).alias("value"))


def running(rows: DataFrame, by: list[str], value: str) -> Column:
    """The running sum of increments, as a cumulative meter shows it."""
    return F.sum(value).over(Window.partitionBy(*by).orderBy("sec"))


def steps(readings: DataFrame, by: list[str], meter: Meter = Meter(), value: str = "value") -> DataFrame:
    """(by, sec, step) of consecutive readings; resets, gaps and leaps are left
    out and never read as 0. A step bears the later stamp."""
    gap, step = F.col("sec") - F.col("__prev.sec"), F.col(value) - F.col("__prev.value")
    found = with_previous(readings.select(*by, "sec", value), by, value).select(*by, "sec", gap.alias("gap"), step.alias("step"))
    return found.where((F.col("gap") > 0) & (F.col("gap") <= meter.max_gap_s) & F.col("step").between(0, meter.max_step)).select(*by, "sec", "step")


def daily(step_rows: DataFrame, by: list[str], tz: Zone, meter: Meter = Meter()) -> DataFrame:
    """(by, d, total, least, hours, complete): a day counts as complete with
    ``coverage`` of its possible steps. A zone column has to be one of ``by``."""
    days = step_rows.withColumn("d", local_time(F.col("sec"), tz).cast("date")).groupBy(*by, "d").agg(
        F.sum("step").alias("total"), F.min("step").alias("least"), F.count("step").alias("hours")
    )
    return days.withColumn("complete", F.col("hours") >= (day_hours(F.col("d"), tz) - 1) * meter.coverage)
