"""Days of cumulative meters, kept current as readings arrive in any order.

The state of a series is its readings of the last ``horizon``: what a late reading
may still change. A reading replaces an earlier arrival of its stamp. After each
batch the days that the batch touched are told again, as rows that replace those
of the same series and day; a day rests on the readings since the last one before
it, so nothing older is needed and nothing is recomputed from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import snapshots
from ..thresholds import Meter

OUT = "series_id string, d date, total double, least double, hours long, complete boolean"
STATE = "secs binary, values binary"


def _day_hours(day: date, zone: ZoneInfo) -> int:
    start = lambda d: datetime(d.year, d.month, d.day, tzinfo=zone).astimezone(timezone.utc)
    return round((start(day + timedelta(days=1)) - start(day)).total_seconds() / 3600)


def _merged(known: dict[int, float], batch: pd.DataFrame) -> list[int]:
    """Puts a batch's readings in, the last of a stamp by ``seq``, and returns their stamps."""
    batch = batch.sort_values("seq", kind="stable")
    known.update(zip(batch["sec"].astype(int).tolist(), batch["value"].astype(float).tolist()))
    return sorted(set(batch["sec"].astype(int).tolist()))


def meter_days(readings: DataFrame, tz: str = "UTC", meter: Meter = Meter(), horizon_s: int = 7 * 86_400) -> DataFrame:
    """Streaming (series_id, d, total, least, hours, complete) of readings
    (series_id, sec, value, seq), in update mode: a row replaces the one before of
    its series and day, and a day that is left without a step has 0 hours.

    A reading older than ``horizon_s`` before the series' newest one is dropped.
    ``seq`` orders arrivals of one stamp inside a batch; a later batch wins.
    """
    zone = ZoneInfo(tz)

    def day_of(sec: int) -> date:
        return datetime.fromtimestamp(sec, zone).date()

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: dict[int, float] = {}
        if state.exists:
            secs, values = state.get
            known = dict(zip(np.frombuffer(secs, "<i8").tolist(), np.frombuffer(values, "<f8").tolist()))
        oldest = max(known, default=-(1 << 62)) - horizon_s
        stamps: set[int] = set()
        for batch in batches:
            batch = batch[batch["sec"].notna() & batch["value"].notna()]
            stamps.update(_merged(known, batch[batch["sec"] >= oldest]))
        if not stamps:
            return
        order = sorted(known)
        place = {sec: i for i, sec in enumerate(order)}
        # a reading's own step and that of the one behind it change
        touched = {day_of(order[j]) for sec in stamps for j in (place[sec], place[sec] + 1) if j < len(order)}
        steps: dict[date, list[float]] = {d: [] for d in touched}
        for before, sec in zip(order, order[1:]):
            if (d := day_of(sec)) in steps and 0 < sec - before <= meter.max_gap_s and 0 <= known[sec] - known[before] <= meter.max_step:
                steps[d].append(known[sec] - known[before])
        told = [
            (key[0], d, float(np.sum(s)) if s else None, min(s) if s else None, len(s), len(s) >= (_day_hours(d, zone) - 1) * meter.coverage)
            for d, s in sorted(steps.items())
        ]
        # whole days are kept from the horizon on, with the reading before them
        first_day = day_of(order[-1] - horizon_s)
        first = next(i for i, sec in enumerate(order) if day_of(sec) >= first_day)
        order = order[max(0, first - 1) :]
        state.update((np.array(order, "<i8").tobytes(), np.array([known[s] for s in order], "<f8").tobytes()))
        yield pd.DataFrame(told, columns=["series_id", "d", "total", "least", "hours", "complete"])

    keyed = readings.select("series_id", "sec", F.col("value").cast("double").alias("value"), "seq").groupBy("series_id")
    return keyed.applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def keep_days(readings: DataFrame, path: str, checkpoint: str, tz: str = "UTC", meter: Meter = Meter(), horizon_s: int = 7 * 86_400):
    """Starts a query that keeps the table of days at ``path`` (``snapshots.read``)
    current; each batch is one version, and a batch that runs again changes nothing."""
    days = meter_days(readings, tz, meter, horizon_s)
    write = lambda batch, _: snapshots.save(batch, path, ["series_id", "d"]) if not batch.isEmpty() else None
    return days.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
