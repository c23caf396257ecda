"""Meter days kept by state equal the batch over shuffled arrivals."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from emberlane.operators import meters
from emberlane.sources import snapshots
from emberlane.streaming.meters import keep_days
from emberlane.thresholds import Meter

SCHEMA = "series_id string, sec long, value double, seq long"


def arrivals(seed):
    """Readings of two meters over ten days around a change of clocks, with gaps, a reset and corrections."""
    draw, rows = random.Random(seed), []
    first = int(datetime(2026, 3, 25, tzinfo=timezone.utc).timestamp())
    for name in ("gas", "water"):
        level = 100.0
        for k in range(240):
            level += draw.random()
            if k == 130:
                level = 0.0
            if draw.random() > 0.05:
                rows.append((name, first + k * 3600, round(level, 4)))
    draw.shuffle(rows)
    late = [(n, s, v + 0.25) for n, s, v in draw.sample(rows, 20)]  # they replace what came before
    return [(*r, k) for k, r in enumerate(rows + late)]


@pytest.mark.parametrize("seed, batches", [(1, 6), (2, 1), (3, 15)])
def test_stream_equals_the_batch(spark, tmp_path, seed, batches):
    rows = arrivals(seed)
    source, path = str(tmp_path / "in"), str(tmp_path / "days")
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{source}/{k:03d}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        keep_days(stream, path, str(tmp_path / "state"), "Europe/London", Meter(), 30 * 86_400).awaitTermination(120)
    last = spark.createDataFrame(rows, SCHEMA).groupBy("series_id", "sec").agg(F.max_by("value", "seq").alias("value"))
    want = meters.daily(meters.steps(last, ["series_id"]), ["series_id"], "Europe/London").collect()
    got = {(r.series_id, r.d): r for r in snapshots.read(spark, path).where("hours > 0").collect()}
    assert len(got) == len(want) >= 20
    for r in want:
        g = got[r.series_id, r.d]
        assert (g.hours, g.complete) == (r.hours, r.complete)
        assert g.total == pytest.approx(r.total, rel=1e-12) and g.least == pytest.approx(r.least, rel=1e-9, abs=1e-12)


def test_readings_before_the_horizon_are_dropped_and_state_stays_small(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "days")
    hour = lambda k, v, seq: ("m", k * 3600, float(v), seq)
    for k, rows in enumerate([[hour(k, k, k) for k in range(120)], [hour(10, 999, 200), hour(119, 119.5, 201)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{source}/*")
        keep_days(stream, path, str(tmp_path / "state"), "UTC", Meter(), 86_400).awaitTermination(120)
    days = {str(r.d): (r.total, r.hours) for r in snapshots.read(spark, path).collect()}
    assert days["1970-01-01"] == (23.0, 23) and days["1970-01-05"] == (24.5, 24)
