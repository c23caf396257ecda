"""Series in chunks give what whole series give; windows never span a series."""

import re
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlane.operators import air, alignment, chunks, daily, meters, quality
from emberlane.thresholds import AirChange, Meter

BY = ["series_id"]
WHOLE = 1 << 40


@pytest.fixture(scope="module")
def series(spark):
    draw = np.random.default_rng(8)
    rows = []
    for name in ("a", "b"):
        sec, level = 0, 500.0
        for _ in range(400):
            sec += int(draw.choice([3600, 3600, 3600, 7200, 90_000]))
            level += float(draw.normal(0, 3)) if draw.random() < 0.6 else 0.0
            rows.append((name, sec, round(level, 3)))
    return spark.createDataFrame(rows, "series_id string, sec long, value double").repartition(4)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


OPERATORS = {
    "runs": lambda df, size: air.falling_runs(df, BY, AirChange(), size),
    "flat": lambda df, size: daily.drop_flatlines(df, BY, 5, 2.0, size),
    "grid": lambda df, size: alignment.on_grid(df, BY, 3600, 3, size),
    "lines": lambda df, size: alignment.interpolated(df.withColumn("value", F.when(F.col("sec") % 5 != 0, F.col("value")).when(F.col("sec") % 7200 == 0, F.col("value"))), BY, 2, chunk_s=size),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("size", [3600, 5 * 3600, 100_000, chunks.CHUNK_S])
def test_chunks_of_any_size_agree(series, name, size):
    assert rows_of(OPERATORS[name](series, size)) == rows_of(OPERATORS[name](series, WHOLE))


@pytest.mark.parametrize("size", [3600, 50_000, WHOLE])
def test_previous_readings(series, size):
    got = {(r.series_id, r.sec): r["__prev"] for r in chunks.with_previous(series, BY, chunk_s=size).collect()}
    frame = series.toPandas().sort_values(["series_id", "sec"])
    frame["p"] = frame.groupby("series_id")["sec"].shift()
    frame["v"] = frame.groupby("series_id")["value"].shift()
    for r in frame.itertuples():
        prev = got[r.series_id, r.sec]
        assert (prev is None) == pd.isna(r.p) and (prev is None or (prev.sec, prev.value) == (r.p, r.v))


def test_flatlines_and_lines_equal_plain_loops(spark, series):
    frame = series.toPandas().sort_values(["series_id", "sec"])
    want = []
    for name, part in frame.groupby("series_id"):
        v = part["value"].tolist()
        want += [(name, s, x) for k, (s, x) in enumerate(zip(part["sec"], v)) if not (k >= 4 and max(v[k - 4 : k + 1]) - min(v[k - 4 : k + 1]) < 2.0)]
    got = daily.drop_flatlines(series, BY, 5, 2.0, 40_000).select("series_id", "sec", "value").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    holes = [None if k % 7 in (2, 3, 4) or k > 195 else float(k * k % 31) for k in range(200)]
    df = spark.createDataFrame([("s", k * 3600, v) for k, v in enumerate(holes)], "series_id string, sec long, value double")
    got = [r.value for r in alignment.interpolated(df, BY, 2, chunk_s=4 * 3600).orderBy("sec").collect()]
    line = pd.Series(holes, dtype=float).interpolate(limit=2)
    assert [None if pd.isna(x) else round(x, 9) for x in line] == [None if x is None else round(x, 9) for x in got]


@pytest.mark.parametrize(
    "plan",
    [
        partial(meters.steps, by=BY, meter=Meter()),
        partial(air.falling_runs, by=BY),
        partial(daily.drop_flatlines, by=BY),
        partial(alignment.on_grid, by=BY),
        partial(alignment.interpolated, by=BY, most=1),
        partial(quality.cadence, by=BY),
    ],
)
def test_windows_over_readings_are_by_chunk(series, plan):
    """Every window is over chunks' rows, or over the table that has a row for each chunk."""
    text = plan(series)._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]", text)
    assert windows
    for keys, order in windows:
        assert "__chunk" in keys or order.startswith("__chunk")


def test_largest_group_of_a_window_is_a_chunk(spark):
    long = spark.range(200_000).select(F.lit("s").alias("series_id"), (F.col("id") * 300).alias("sec"), (F.col("id") % 50).cast("double").alias("value"))
    sizes = chunks.chunked(long).groupBy(chunks.CHUNK).count().agg(F.max("count")).first()[0]
    assert sizes <= chunks.CHUNK_S // 300
    assert meters.steps(long, BY).count() == 200_000 - 4_000
