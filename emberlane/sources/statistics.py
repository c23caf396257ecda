"""Hourly statistics laid out for pruned scans, read in the units the analyses need.

A table of statistics has rows (series_id, sec, mean, sum, unit), one an hour and
series; ``mean`` is a measurement's, ``sum`` a cumulative meter's. It lies in
folders by a bucket of the series and by month, sorted by series and time, so a
scan for some series and a time range opens the folders of those buckets and
months only, and in their files the row groups of those series and stamps.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.meters import local_time

BUCKETS = 64

#: Units of a quantity, as (unit, factor, offset) to kWh, °C and litres.
UNITS: dict[str, list[tuple[str, float, float]]] = {
    "energy": [
        ("Wh", 0.001, 0.0), ("kWh", 1.0, 0.0), ("MWh", 1000.0, 0.0), ("GWh", 1e6, 0.0),
        ("kJ", 1 / 3600, 0.0), ("MJ", 1 / 3.6, 0.0), ("GJ", 1000 / 3.6, 0.0),
    ],
    "temperature": [("°C", 1.0, 0.0), ("°F", 5 / 9, -160 / 9), ("K", 1.0, -273.15)],
    "volume": [
        ("mL", 0.001, 0.0), ("L", 1.0, 0.0), ("m³", 1000.0, 0.0),
        ("ft³", 28.316846592, 0.0), ("CCF", 2831.6846592, 0.0), ("gal", 3.785411784, 0.0),
    ],
    "share": [("%", 1.0, 0.0)],
    "concentration": [("ppm", 1.0, 0.0)],
}


def bucket_of(series_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(series_id), F.lit(buckets)).cast("int")


def month_of(sec: Column) -> Column:
    day = local_time(sec, "UTC")
    return (F.year(day) * 100 + F.month(day)).cast("int")


def land(rows: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    """Writes statistics in their layout; each folder's rows come from one task."""
    placed = rows.withColumns({"bucket": bucket_of(F.col("series_id"), buckets), "month": month_of(F.col("sec"))})
    placed = placed.repartition("bucket", "month").sortWithinPartitions("bucket", "month", "series_id", "sec")
    placed.write.mode(mode).partitionBy("bucket", "month").parquet(path)


def units_table(spark: SparkSession, units: Mapping[str, list[tuple[str, float, float]]] = UNITS) -> DataFrame:
    rows = [(quantity, unit, factor, offset) for quantity, known in units.items() for unit, factor, offset in known]
    return spark.createDataFrame(rows, "quantity string, unit string, factor double, offset double")


def _months(since: int, until: int) -> list[int]:
    first, last = (datetime.fromtimestamp(s, timezone.utc) for s in (since, max(since, until - 1)))
    return [(m // 12) * 100 + m % 12 + 1 for m in range(first.year * 12 + first.month - 1, last.year * 12 + last.month)]


def scan(spark: SparkSession, path: str, wanted: Mapping[str, str] | DataFrame, since: int, until: int, buckets: int = BUCKETS, units: Mapping = UNITS) -> DataFrame:
    """(series_id, quantity, sec, mean, sum) of the ``wanted`` series with stamps
    in [since, until), in kWh, °C, litres, % or ppm; a unit that the quantity
    doesn't have gives null, never an unconverted number.

    ``wanted`` tells each series' quantity: a mapping, such as a home's
    configuration, whose ids and buckets become literals of the scan; or a table
    (series_id, quantity) of any size, whose buckets (``buckets`` numbers at most)
    are asked for first, and which is then met by bucket and series.
    """
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("month").isin(_months(since, until)) & (F.col("sec") >= since) & (F.col("sec") < until))
    if isinstance(wanted, DataFrame):
        told = wanted.select("series_id", "quantity").distinct().withColumn("bucket", bucket_of(F.col("series_id"), buckets))
        rows = rows.where(F.col("bucket").isin([r.bucket for r in told.select("bucket").distinct().collect()]))
    else:
        ids = sorted(wanted)
        rows = rows.where(F.col("bucket").isin(*(bucket_of(F.lit(i), buckets) for i in ids)) & F.col("series_id").isin(ids))
        told = F.broadcast(spark.createDataFrame(sorted(wanted.items()), "series_id string, quantity string")).withColumn("bucket", bucket_of(F.col("series_id"), buckets))
    met = rows.join(told, ["bucket", "series_id"]).join(F.broadcast(units_table(spark, units)), ["quantity", "unit"], "left")
    return met.select(
        "series_id", "quantity", "sec", (F.col("mean") * F.col("factor") + F.col("offset")).alias("mean"), (F.col("sum") * F.col("factor")).alias("sum")
    )
