"""Structured Streaming: hourly means as they arrive, and upserts into a cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.telemetry import save


def hourly_means(readings: DataFrame, late: str = "6 hours") -> DataFrame:
    """Streaming (series_id, hour, mean, n) of rows (series_id, ts timestamp, value);
    rows later than ``late`` no longer count."""
    hours = readings.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "series_id").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return hours.select("series_id", F.col("window.start").alias("hour"), "mean", "n")


def upsert_stream(readings: DataFrame, path: str, checkpoint: str):
    """Starts a query that upserts every batch of (series_id, source, sec, value)
    into the Parquet cache at ``path``; a batch that is run again changes nothing."""
    return readings.writeStream.foreachBatch(lambda batch, _: save(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
