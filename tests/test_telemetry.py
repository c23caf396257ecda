"""Scenarios of the telemetry operators with known answers."""

import math
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlane.functions import stats
from emberlane.operators import air, alignment, cooling, daily, heatloss, hotwater, meters, offline, quality, usage
from emberlane.plans import report
from emberlane.sources import telemetry
from emberlane.streaming import ingest
from emberlane.thresholds import HeatLoss, Home, Meter

LONDON = "Europe/London"


def sec(*when):
    return int(datetime(*when, tzinfo=timezone.utc).timestamp())


def readings(spark, values, start=sec(2026, 1, 5), step=3600, name="s"):
    return spark.createDataFrame([(name, start + k * step, float(v)) for k, v in enumerate(values)], "series_id string, sec long, value double")


def days_frame(spark, q, dt, step=1, hot=None):
    first = date(2000, 1, 1)
    rows = [("h", first + timedelta(days=k * step), float(a), float(b), float((hot or [0] * len(q))[k])) for k, (a, b) in enumerate(zip(q, dt))]
    return spark.createDataFrame(rows, "home string, d date, q double, delta_t double, hot double")


def fitted(spark, *args, hot_water=None, **kw):
    points = heatloss.fit_points(days_frame(spark, *args, **kw), hot_water=hot_water)
    rows = heatloss.fit(points, ["home"]).collect()
    return rows[0] if rows else None


DT40 = [5 + i % 10 for i in range(40)]


def test_known_slope(spark):
    r = fitted(spark, [2 + 5.76 * t for t in DT40], DT40)
    assert r.hlc == pytest.approx(240) and r.r2 == pytest.approx(1) and r.n == 40 and r.status == "valid"


@pytest.mark.parametrize(
    "q, reason",
    [([80 - 2 * t for t in DT40], "slope isn't positive"), ([30 + 0.1 * t + (10 if (i // 10) % 2 else -10) for i, t in enumerate(DT40)], "weak fit"), ([2 + 5.76 * t for t in DT40[:19]], "too few days")],
)
def test_rejections(spark, q, reason):
    r = fitted(spark, q, DT40[: len(q)])
    assert r.status == "invalid" and r.rejection_reason == reason and r.hlc is not None


def test_runs_of_errors_widen_the_limits(spark):
    line = [2 + 5.76 * t for t in DT40]
    swing = fitted(spark, [y + (1.5 if i % 2 else -1.5) for i, y in enumerate(line)], DT40)
    runs = fitted(spark, [y + (1.5 if (i // 7) % 2 else -1.5) for i, y in enumerate(line)], DT40)
    assert swing.r1 <= 0 and swing.effective_days == pytest.approx(40)
    assert runs.r1 > 0.4 and runs.effective_days < 40 and runs.ci_high - runs.ci_low > swing.ci_high - swing.ci_low


def test_no_adjacent_days(spark):
    r = fitted(spark, [2 + 5.76 * t + (i % 3) for i, t in enumerate(DT40)], DT40, step=2)
    assert r.pairs == 0 and r.r1 == 0 and r.effective_days == pytest.approx(40)


def test_hot_water_above_use_leaves_nothing(spark):
    q = [2 + 5.76 * t for t in DT40]
    assert fitted(spark, q, DT40, hot=[x + 1 for x in q], hot_water="hot") is None


def test_constant_lines(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (None, 1.0)], "y double, x double")
    flat_x = df.agg(*stats.ols("y", "x")).first()
    assert (flat_x.slope, flat_x.intercept, flat_x.r2, flat_x.n) == (0, 2, 0, 2)
    flat_y = spark.createDataFrame([(2.0, 1.0), (2.0, 5.0)], "y double, x double").agg(*stats.ols("y", "x")).first()
    assert flat_y.r2 == 0


def test_gap_is_no_use(spark):
    rows = spark.createDataFrame([("m", h * 3600, v) for h, v in ((0, 100.0), (1, 101.0), (25, 121.0), (26, 122.0))], "series_id string, sec long, value double")
    assert [(r.sec, r.step) for r in meters.steps(rows, ["series_id"]).orderBy("sec").collect()] == [(3600, 1.0), (26 * 3600, 1.0)]


def test_partial_day(spark):
    days = meters.daily(meters.steps(readings(spark, range(36)), ["series_id"]), ["series_id"], "UTC").where("complete").collect()
    assert [(r.d, r.total) for r in days] == [(date(2026, 1, 5), 23.0)]


@pytest.mark.parametrize("day, hours", [(date(2026, 3, 29), 23), (date(2026, 10, 25), 25), (date(2026, 6, 1), 24)])
def test_clock_changes(spark, day, hours):
    assert spark.range(1).select(meters.day_hours(F.lit(day), LONDON).alias("h")).first().h == hours
    start = int((datetime(day.year, day.month, day.day, tzinfo=timezone.utc) - timedelta(hours=5)).timestamp())
    local = meters.daily(meters.steps(readings(spark, range(40), start), ["series_id"]), ["series_id"], LONDON).where(F.col("d") == day).first()
    assert local.hours == hours and local.complete


def test_heating_off(spark):
    d = [date(2026, 1, k) for k in range(1, 5)]
    dt = spark.createDataFrame(list(zip("hhhh", d, [2.0, 5.0, 12.0, 1.5])), "home string, d date, delta_t double")
    heat = spark.createDataFrame([("h", d[0], 4.0), ("h", d[1], 0.2)], "home string, d date, heat_pct double")
    off = {r.d for r in daily.heating_off(dt, heat, ["home"]).where("off").collect()}
    assert off == {d[1], d[3]}


def test_every_room_must_report(spark):
    both = readings(spark, [20] * 48, name="a").union(readings(spark, [22] * 24, name="b")).union(readings(spark, [11] * 48, name="o"))
    rows = daily.daily_delta_t(both, ["a", "b"], "o", [], "UTC").collect()
    assert [(r.d, r.delta_t) for r in rows] == [(date(2026, 1, 5), 10.0)]
    assert daily.daily_delta_t(both, ["a", "silent"], "o", [], "UTC").count() == 0


def water_days(spark, rows):
    return spark.createDataFrame([("h", date(2026, 1, 1) + timedelta(days=k), *map(lambda x: None if x is None else float(x), r), True) for k, r in enumerate(rows)], "home string, d date, q double, outdoor double, water double, off boolean")


def test_baseline_leaves_out_away_days(spark):
    r = hotwater.baseline(water_days(spark, [(12, 15, 400)] * 12 + [(0.3, 15, 5)] * 8), ["home"]).first()
    assert (r.baseline, r.days_used, r.away_days, r.idle_kwh, r.status) == (12, 12, 8, 0.3, "provisional")
    early = hotwater.baseline(water_days(spark, [(12, 15, None)] * 10 + [(12, 15, 400)] * 10), ["home"]).first()
    assert (early.days_used, early.away_days, early.status) == (20, 0, "valid")


def test_water_rate(spark):
    def row(i, rate):
        outdoor, litres = 4 + i, 300 + 20 * i
        mains = 4 + 12 * min(1, max(0, (outdoor - 2) / 16))
        return litres * rate * (55 - mains) / 1000, outdoor, litres

    good = hotwater.water_rate(water_days(spark, [row(i, 0.6) for i in range(15)]), ["home"]).first()
    assert good.rate == pytest.approx(0.6) and good.usable
    assert not hotwater.water_rate(water_days(spark, [row(i, 0.6) for i in range(9)]), ["home"]).first().usable
    assert not hotwater.water_rate(water_days(spark, [row(i, 2.5) for i in range(15)]), ["home"]).first().usable


def test_outlier_falls_back_on_the_mains(spark):
    day = spark.createDataFrame([("h", False, 45.0, 15.0, 5000.0, 10.0, 15.0, 0.6, 2000.0)], "home string, off boolean, q double, outdoor double, water double, baseline double, reference_c double, rate double, limit double")
    r = hotwater.attribute(day).first()
    assert (r.hot_kwh, r.how, r.outlier) == (10.0, "mains", True)


def test_electricity(spark):
    rows = [("h", date(2026, 1, 1) + timedelta(days=k), 0.15 * 24 + 0.5 * 12, 0.15) for k in range(20)]
    r = usage.electricity(spark.createDataFrame(rows, "home string, d date, total double, least double"), ["home"]).first()
    assert r.baseload_w == pytest.approx(150) and r.kwh_per_day == pytest.approx(9.6) and r.usable
    assert not usage.electricity(spark.createDataFrame(rows[:10], "home string, d date, total double, least double"), ["home"]).first().usable


def nights_of(spark, tau, heat=None):
    rows, out = [], []
    for night in range(4):
        t0 = sec(2026, 1, 10 + night)
        for h in range(6):
            rows.append(("t", t0 + h * 3600, 5 + 15 * math.exp(-h / tau)))
            out.append((t0 + h * 3600, 5.0))
    rooms = spark.createDataFrame([("room", "t", "heater" if heat is not None else None)], "room string, temp_series string, heat_series string")
    frame = lambda x: spark.createDataFrame(x, "series_id string, sec long, value double")
    outside = spark.createDataFrame(out, "sec long, value double")
    return cooling.fit_tau(cooling.nights(frame(rows), rooms, outside, [], "UTC", heat=frame(heat) if heat is not None else None))


@pytest.mark.parametrize("tau, fits", [(15, 4), (190, 4), (230, 0)])
def test_time_constants(spark, tau, fits):
    r = cooling.summary(nights_of(spark, tau), []).first()
    assert r.nights_fitted == fits and (not fits or abs(r.tau_median_h - tau) <= 0.25)


def test_silent_heating_sensor_rejects(spark):
    rows = nights_of(spark, 15, heat=[]).collect()
    assert len(rows) == 4 and {r.rejection_reason for r in rows} == {"heating unknown"}


@pytest.mark.parametrize("ratio, usable", [(0.35, True), (-0.2, False), (1.67, False)])
def test_loft(spark, ratio, usable):
    at = [sec(2026, 1, 10 + n, h) for n in range(4) for h in range(1, 6)]
    frame = lambda v: spark.createDataFrame([(t, float(v)) for t in at], "sec long, value double")
    r = air.loft_ratio(frame(20), frame(5 + 15 * ratio), frame(5), [], "UTC").first()
    assert r.ratio == pytest.approx(ratio) and r.usable == usable and r.rows == 20


def test_air_changes(spark):
    values = []
    for _ in range(12):
        values += [420 + 800 * math.exp(-0.3 * h) for h in range(7)] + [1300]
    rows = readings(spark, values)
    fits = air.decay_fits(rows, air.baseline_ppm(rows, ["series_id"], configured=420.0), ["series_id"])
    r = air.air_change_rate(fits, ["series_id"]).first()
    assert r.ach == pytest.approx(0.3, abs=0.02) and r.windows >= 10 and r.usable


def test_losses_add_up(spark):
    r = air.split_losses(spark.createDataFrame([(270.0, 0.3), (40.0, 5.0)], "hlc double, ach double"), "hlc", "ach", F.lit(240.0)).collect()
    assert r[0].ventilation_w_per_k + r[0].fabric_w_per_k == pytest.approx(270) and r[0].ventilation_w_per_k == pytest.approx(0.335 * 72)
    assert r[1].ventilation_w_per_k is None
    rates = spark.createDataFrame([(0.2, 12, 420.0), (0.35, 18, 421.0), (1.4, 10, 419.0)], "ach double, windows long, baseline double")
    assert tuple(air.combine(rates).first()) == (0.35, 40, 420.0, 3)


def test_gas_on_water(spark):
    litres = readings(spark, [1 + i % 10 for i in range(260)]).withColumnRenamed("value", "step")
    gas = litres.withColumn("step", 0.1 + 0.018 * F.col("step"))
    r = hotwater.gas_water(gas, litres, ["series_id"]).first()
    assert r.wh_per_litre == pytest.approx(18) and r.r2 > 0.9 and r.usable
    weak = litres.withColumn("step", 0.2 + 0.002 * F.col("step") + F.when((F.col("sec") / 3600) % 2 < 1, 0.12).otherwise(-0.12))
    assert not hotwater.gas_water(weak, litres, ["series_id"]).first().usable


def test_flatlines(spark):
    kept = daily.drop_flatlines(readings(spark, [20.0] * 30 + [25.0, 26.0]), ["series_id"]).count()
    assert kept == 23 + 2


def test_interpolation_equals_pandas(spark):
    draw = np.random.default_rng(3)
    values = [None if draw.random() < 0.5 else float(round(draw.normal(), 3)) for _ in range(80)]
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate(values)], "series_id string, sec long, value double")
    for most in (1, 3):
        got = [r.value for r in alignment.interpolated(df, ["series_id"], most).orderBy("sec").collect()]
        want = pd.Series(values, dtype=float).interpolate(limit=most)
        assert [None if math.isnan(x) else round(x, 9) for x in want] == [None if x is None else round(x, 9) for x in got]


def test_nearest_equals_pandas(spark):
    draw = np.random.default_rng(5)
    left, right = (np.unique(draw.integers(0, 3000, 250)) for _ in range(2))
    frame = lambda x: spark.createDataFrame([("s", int(t), float(t)) for t in x], "series_id string, sec long, value double")
    got = {r.sec: r.right_sec for r in alignment.nearest(frame(left), frame(right), ["series_id"], 7).collect()}
    for t in left.tolist():
        near = sorted((abs(t - u), u) for u in right.tolist() if abs(t - u) <= 7)
        assert got[t] == (near[0][1] if near else None)


def test_cache_upsert_and_merge(spark, tmp_path):
    rows = lambda x: spark.createDataFrame([("s", "lts", k, float(v)) for k, v in x], "series_id string, source string, sec long, value double")
    path = str(tmp_path / "cache")
    telemetry.save(rows([(0, 10), (3600, 11)]), path)
    for _ in range(2):
        telemetry.save(rows([(3600, 12.5)]), path)
    assert sorted((r.sec, r.value) for r in spark.read.parquet(path).collect()) == [(0, 10.0), (3600, 12.5)]


def cache(spark, rows):
    return spark.createDataFrame([(*r[:3], float(r[3])) for r in rows], "home string, source string, sec long, value double")


def test_merge_takes_proven_offsets_and_tells_what_it_rejects(spark):
    hours = range(6)
    rows = [("a", "lts", k * 3600, 100 + k) for k in hours] + [("a", "rest", k * 3600 + 60, 1100 + k) for k in range(3, 8)]
    rows += [("b", "lts", k * 3600, 50 + k) for k in hours] + [("b", "rest", k * 3600, 70 + 9 * k) for k in hours]  # no constant offset
    rows += [("c", "own", k * 3600, k) for k in range(9)] + [("c", "rest", k * 3600, 5 + k) for k in range(4)]  # no lts: the widest
    merged, decisions = quality.merge_cumulative(cache(spark, rows), ["home"])
    told = {(r.home, r.source): (r.used, r.anchor, r.offset) for r in decisions.collect()}
    assert told[("a", "rest")] == (True, False, 1000.0) and told[("b", "rest")][0] is False
    assert told[("c", "own")] == (True, True, 0.0) and told[("c", "rest")] == (True, False, 5.0)
    values = {}
    for r in merged.collect():
        values.setdefault(r.home, {})[r.sec] = r.value
    assert values["b"] == {k * 3600: 50.0 + k for k in hours} and values["c"] == {k * 3600: float(k) for k in range(9)}
    assert values["a"][7 * 3600 + 60] == 107.0 and len(values["a"]) == 11


def test_load_policy(spark):
    rows = [("a", "lts", 0, 1, "cumulative"), ("a", "rest", 0, 1, "cumulative"), ("b", "rest", 0, 1, "cumulative"), ("b", "x", 0, 2, "measurement"), ("b", "x", 60, 2, "measurement")]
    rows += [("c", "lts", 0, 1, "measurement"), ("c", "rest", 0, 2, None), ("d", "own", 0, 3, None)]
    table = spark.createDataFrame([(a, b, c, float(d), e) for a, b, c, d, e in rows], "home string, source string, sec long, value double, kind string")
    found = {r.home: (r.policy, r.preferred) for r in quality.load_policy(table, ["home"]).collect()}
    assert found == {"a": ("merge cumulative", None), "b": ("one source", "x"), "c": ("merge measurements", None), "d": ("merge measurements", None)}
    got = sorted(tuple(r) for r in quality.load(table, ["home"]).collect())
    assert got == [("a", 0, 1.0), ("b", 0, 2.0), ("b", 60, 2.0), ("c", 0, 2.0), ("d", 0, 3.0)]  # rest wins in c
    assert [tuple(r) for r in quality.load(table, ["home"], "rest").where("home = 'b'").collect()] == [("b", 0, 1.0)]


def test_repair_refuses_mixed_baselines(spark):
    rows = [("a", "x", k * 3600, v, 1) for k, v in enumerate([100, 1100, 101, 1101, 102, 1102])]
    rows += [("a", "y", 0, 5, 1), ("a", "y", 0, 6, 2), ("a", "y", 3600, 7, 1), ("a", "z", 0, float("nan"), 1)]
    table = spark.createDataFrame([(*r[:3], float(r[3]), r[4]) for r in rows], "home string, source string, sec long, value double, seq long")
    clean, statuses = quality.repair(table, ["home"], 40.0)
    assert {r.source: (r.status, r.rows) for r in statuses.collect()} == {"x": ("refused", None), "y": ("rewritten", 2), "z": ("missing", None)}
    assert sorted((r.source, r.sec, r.value) for r in clean.collect()) == [("y", 0, 6.0), ("y", 3600, 7.0)]


def test_saves_keep_one_row_of_a_stamp(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = lambda x: spark.createDataFrame([("s", "lts", *r) for r in x], "series_id string, source string, sec long, value double, seq long")
    telemetry.save(rows([(0, 1.0, 1), (0, 3.0, 3), (0, 2.0, 2)]), path, kind="cumulative")
    assert [(r.value, r.kind) for r in spark.read.parquet(path).collect()] == [(3.0, "cumulative")]
    telemetry.save(rows([(0, 9.0, 1), (0, 8.0, 2), (60, 5.0, 1)]), path)
    assert sorted((r.sec, r.value) for r in spark.read.parquet(path).collect()) == [(0, 8.0), (60, 5.0)]
    assert [tuple(r) for r in telemetry.available_sources(spark.read.parquet(path)).collect()] == [("s", ["lts"])]


def test_files_that_may_be_absent(spark, tmp_path):
    assert telemetry.read_csv_cache(spark, str(tmp_path / "none.csv"), "s") is None
    (tmp_path / "some.csv").write_text("timestamp,value\n2026-01-01T00:00:00Z,4\n")
    assert telemetry.read_csv_cache(spark, str(tmp_path / "some.csv"), "s").first().value == 4.0
    assert telemetry.read_sidecar(spark, str(tmp_path / "none.json")) == {}
    (tmp_path / "bad.json").write_text("{nothing")
    (tmp_path / "good.json").write_text('{"kind": "cumulative", "rows": 3}')
    assert telemetry.read_sidecar(spark, str(tmp_path / "bad.json")) == {}
    assert telemetry.read_sidecar(spark, str(tmp_path / "good.json")) == {"kind": "cumulative", "rows": 3}
    for k, rows in enumerate([[(0, 1.0), (1, 2.0)], [(1, 5.0), (2, 3.0)]]):
        spark.createDataFrame(rows, "sec long, value double").write.parquet(str(tmp_path / f"slice{k}"))
    both = telemetry.read_chunks(spark, [str(tmp_path / f"slice{k}") for k in (0, 1)], ["sec"])
    assert sorted(tuple(r) for r in both.collect()) == [(0, 1.0), (1, 2.0), (2, 3.0)]
    config = spark.createDataFrame([("rooms", ["a", "FILL_ME_IN", "", None]), ("loft", ["a"])], "role string, series_ids array<string>")
    assert sorted(tuple(r) for r in telemetry.wanted_ids(config).collect()) == [("loft", "a"), ("rooms", "a")]


def test_first_statistics_row_of_a_stamp_stays(spark):
    rows = spark.createDataFrame([("s", 3600.0, 1.0, None), ("s", 3600.0, 2.0, None)], "series_id string, start double, mean double, sum double").coalesce(1)
    assert [r.value for r in telemetry.read_statistics(rows).collect()] == [1.0]


def test_outliers_count_without_a_rate(spark):
    rows = [("h", date(2026, 1, k), False, 20.0, 5.0, w, 10.0, 12.0, None, 300.0) for k, w in ((1, 900.0), (2, 100.0), (3, None))]
    rows.append(("h", date(2026, 1, 4), True, 20.0, 5.0, 900.0, 10.0, 12.0, None, 300.0))
    df = spark.createDataFrame(rows, "home string, d date, off boolean, q double, outdoor double, water double, baseline double, reference_c double, rate double, limit double")
    got = [(r.how, r.outlier) for r in hotwater.attribute(df).orderBy("d").collect()]
    assert got == [("mains", True), ("mains", False), ("mains", False), ("off", False)]


def test_outdoor_air_is_of_the_home(spark):
    rows = spark.createDataFrame([(h, "in", k, 500.0 + k) for h in "ab" for k in range(5)], "home string, series_id string, sec long, value double")
    outside = spark.createDataFrame([("a", 0, 410.0), ("a", 1, 430.0)], "home string, sec long, value double")
    found = {r.home: (r.baseline, r.baseline_source) for r in air.baseline_ppm(rows, ["home", "series_id"], measured=outside).collect()}
    assert found == {"a": (420.0, "sensor"), "b": (500.0, "percentile")}


def test_change_is_against_what_was_before(spark):
    row = spark.range(1).select(stats.change_pct(F.lit(3.0), F.lit(-2.0)).alias("a"), stats.change_pct(F.lit(3.0), F.lit(0.0)).alias("b")).first()
    assert row.a == -250.0 and row.b is None


def cooled(tau, hours, step=300, out=2.0, first=20.0):
    return [out + (first - out) * math.exp(-k * step / 3600 / tau) for k in range(int(hours * 3600 / step) + 1)]


def test_nights_across_midnight(spark):
    start = sec(2026, 1, 5, 22)
    rows = [("den", start + k * 300, v) for k, v in enumerate(cooled(30.0, 34))]
    room = spark.createDataFrame(rows, "room string, sec long, value double")
    outdoor = spark.createDataFrame([(r[0], r[1], 2.0) for r in rows], "room string, sec long, value double")
    fits = cooling.fit_tau(cooling.long_nights(room, outdoor, ["room"], "UTC")).orderBy("d").collect()
    assert [(r.d, r.tau_h, r.rejection_reason, r.n_points) for r in fits] == [(date(2026, 1, 5), 30.0, None, 85), (date(2026, 1, 6), 30.0, None, 85)]
    heat = room.withColumn("value", F.when(F.col("sec") < sec(2026, 1, 6, 12), 50.0).otherwise(0.0))
    told = {r.d: r.rejection_reason for r in cooling.long_nights(room, outdoor, ["room"], "UTC", heat=heat).collect()}
    assert told == {date(2026, 1, 5): "heated", date(2026, 1, 6): None}
    rooms = spark.createDataFrame([("den",), ("hall",)], "room string")
    found = {r.room: (r.nights_fitted, r.tau_median_h) for r in cooling.summary(spark.createDataFrame(fits, "room string, d date, points array<struct<sec:long,temp:double,out:double>>, n_points long, rejection_reason string, tau_h double, sse double, r2 double"), [], rooms).collect()}
    assert found == {"den": (2, 30.0), "hall": (0, None)}


def test_offline_fit_and_its_notes(spark):
    dt = [4.5 + k * 0.3 for k in range(40)]
    days = days_frame(spark, [10 + 5.76 * x for x in dt], dt).withColumn("home", F.lit("h"))
    heat, delta = days.select("home", "d", "q"), days.select("home", "d", "delta_t")
    good = offline.fit_joined(heat, delta, ["home"]).first()
    assert good.note is None and good.hlc == pytest.approx(240.0)
    few = offline.fit_joined(heat.orderBy("d").limit(10), delta, ["home"]).first()
    assert few.hlc is None and few.note == "no result: too few days"
    zones = spark.createDataFrame([("s", k * 3600, 50.0) for k in range(24)] + [("t", k * 3600, 100.0) for k in range(24)], "series_id string, sec long, value double")
    assert offline.zone_heat_kwh(zones, 28.0, [], "UTC").first().q == pytest.approx(0.75 * 28 * 24)


def test_categories_in_order(spark):
    rows = [("sensor.loft_outdoor_temp", None, "temperature", "°C"), ("sensor.x", "Garden air", "temperature", None), ("sensor.den_temperature", None, None, "°F"), ("sensor.den_heating", "Den", None, "%"), ("sensor.meter", "Meter", "gas", "m³"), ("sensor.air", "", "carbon_dioxide", "ppm"), ("sensor.tariff", "Gas price", "monetary", "GBP/kWh"), ("sensor.power_price", "Price", "monetary", "GBP/kWh"), ("climate.den", None, None, None), ("light.gas", None, "gas", "kWh")]
    found = report.categorised(spark.createDataFrame(rows, "entity_id string, friendly_name string, device_class string, unit string"))
    got = {r.entity_id: r.category for r in found.collect()}
    assert list(map(got.get, (r[0] for r in rows))) == ["loft_temperature", "outdoor_temperature", "indoor_temperature", "heating_power", "energy", "co2", "gas_rate", None, "climate", None]
    assert [tuple(r) for r in report.drafted_rooms(found).collect()] == [("den", "sensor.den_temperature", "sensor.den_heating")]
    assert {tuple(r) for r in report.drafted_roles(found).collect()} >= {("gas_kwh_entity", "sensor.meter"), ("co2_entity", "sensor.air")}


def season(first, n, home="a"):
    rows = []
    for k in range(n):
        outdoor = 12 - 10 * math.sin(k / 200 * math.pi)
        dt = 20 - outdoor
        off = dt < 9
        rows.append((home, first + timedelta(days=k), off, 10.0 + (0 if off else 5.76 * dt), outdoor, dt, 300.0, 0.0 if off else 50.0, 8.0 + k % 3, 0.1))
    return rows


DAYS = "home string, d date, off boolean, q double, outdoor double, delta_t double, water double, heat_pct double, kwh double, least double"


def test_summer_moves_nothing_of_the_heating_model(spark):
    rows = season(date(2025, 9, 1), 200)
    last = max(r[1] for r in rows if not r[2])
    rows = [r for r in rows if r[1] <= last]
    summer = [("a", last + timedelta(days=k), True, 60.0 + k, 22.0, -2.0, 2000.0, 0.0, 8.0, 0.1) for k in range(1, 41)]
    of = lambda x: report.heat_loss(report.complete_days(spark.createDataFrame(x + [("a", x[-1][1] + timedelta(days=1), True, 1.0, 20.0, 0.0, 1.0, 0.0, 1.0, 0.1)], DAYS), ["home"]), ["home"], 0.9, 100.0, [60, 120, 365]).first()
    before, after = of(rows), of(rows + summer)
    assert before == after and before.model_data_through == last
    assert before.recent_window_days == 60 and before.recent_days_used >= 20


def test_reports_tell_what_is_missing(spark):
    rows = season(date(2025, 9, 1), 200) + [("b", date(2025, 9, 1) + timedelta(days=k), True, 5.0, 15.0, 2.0, None, None, 3.0 if k < 4 else None, 0.1) for k in range(12)]
    days = report.complete_days(spark.createDataFrame(rows, DAYS), ["home"])
    power = {r.home: r for r in report.electricity_use(days, ["home"], 365, 0.25).collect()}
    assert power["b"].unavailable_reason == "4 of 14 days" and power["b"].kwh_per_day is None
    assert power["a"].unavailable_reason is None and power["a"].kwh_per_day == 9.0 and power["a"].lag_days == 0
    water = {r.home: r for r in report.water_use(days, ["home"], 365).collect()}
    assert water["b"].unavailable_reason == "0 of 5 days" and (water["a"].litres_7d, water["a"].threshold) == (300.0, 900.0)
    hot = {r.home: r for r in report.hot_water(days, ["home"], 365, 0.07).collect()}
    assert hot["a"].kwh_per_day == 10.0 and hot["a"].status == "provisional" and hot["b"].kwh_per_day == 5.0 and hot["b"].latest_water_day is None


def test_what_to_look_at_first(spark):
    df = spark.createDataFrame([(300.0, 100.0), (150.0, 100.0), (None, 100.0)], "f double, v double")
    assert [r.x for r in df.select(report.decision(F.col("f"), F.col("v")).alias("x")).collect()] == ["fabric first", "ventilation matters", "no split available"]
    rooms = spark.createDataFrame([("den", 20.0), ("hall", None), ("bath", 9.0), ("loft", 12.0)], "room string, tau_median_h double")
    assert report.fastest(rooms, []).first().fastest == "bath, loft"
    assert {r.room: (r.place, r.slowest_place) for r in report.ranked(rooms, []).collect()} == {"bath": (1, 3), "loft": (2, 2), "den": (3, 1), "hall": (4, None)}


def test_normalised_stamps(spark):
    df = spark.createDataFrame([("s", "2026-01-01T01:00:00+01:00", "1"), ("s", "2026-01-01 01:00:00", "2"), ("s", "bad", "3"), ("s", "2026-01-01T02:00:00+00:00", "nan"), ("s", "2026-01-01T00:00:00Z", "9")], "series_id string, timestamp string, value string")
    assert sorted((r.sec - sec(2026, 1, 1), r.value) for r in telemetry.normalised(df.coalesce(1)).collect()) == [(0, 9.0), (3600, 2.0)]


def test_audit_sees_two_baselines(spark):
    values = [100, 1100, 101, 1101, 102, 1102]
    assert quality.audit(readings(spark, values), ["series_id"], 40).first().mixed
    assert not quality.audit(readings(spark, range(6)), ["series_id"], 40).first().mixed


def test_tariffs(spark):
    df = spark.createDataFrame([("5.25", "p/kWh"), ("5.25", "kWh"), ("18.4", "p / kWh"), ("-1", "GBP/kWh"), ("unknown", "GBP/kWh"), ("0", "GBP/kWh")], "v string, u string")
    got = [r.x for r in df.select(usage.tariff_per_kwh(F.col("v"), F.col("u")).alias("x")).collect()]
    assert got == [pytest.approx(0.0525), None, pytest.approx(0.184), None, None, 0.0]


def test_trailing_windows(spark):
    rows = spark.createDataFrame([("h", date(2026, 1, 1) + timedelta(days=k), float(k)) for k in range(10) if k != 8], "home string, d date, v double")
    t = lambda *a, **b: stats.trailing(rows, ["home"], "d", "v", *a, **b)
    last = rows.select("d", t(3, 2).alias("m"), t(3, 3).alias("g"), t(3, kind="count").alias("n"), t(3, shift=3).alias("p"), t(3, kind="median").alias("md")).orderBy(F.desc("d")).first()
    assert (last.m, last.g, last.n, last.p, last.md) == (8.0, None, 2, 5.0, 8.0)


def test_composite_keeps_every_home(spark):
    rows = season(date(2025, 9, 1), 200) + [("b", date(2025, 9, 1) + timedelta(days=k), True, 5.0, 15.0, 2.0, None, None, None, None) for k in range(2)]
    days = report.complete_days(spark.createDataFrame(rows, DAYS), ["home"])
    out = {r.home: r for r in report.composite(days, ["home"], 0.9, 100.0, 0.07, 0.25).collect()}
    assert set(out) == {"a", "b"} and out["b"].hlc_status == "invalid" and out["b"].hlc_unavailable_reason == "no usable days"
    assert out["a"].hlc_status == "valid" and abs(out["a"].hlc_w_per_k - 0.9 * 240) < 20 and out["a"].hlc_band in ("fair", "good")
    assert out["a"].dhw_kwh_per_day == 10.0 and out["a"].elec_kwh_per_day == 9.0


def test_home_bounds():
    assert Home({"r": "t"}, co2_series="one").co2_series == ["one"]
    assert Home({"r": "t"}, window_days=100).windows() == [60, 100]
    assert Home({"r": "t"}, away_litres=0).away_litres == 0
    typed = Home({"r": "t"}, floor_area_m2="80", window_days="90", loft_since="2026-01-02")
    assert (typed.floor_area_m2, typed.window_days) == (80.0, 90) and typed.loft_cutoff(date(2025, 1, 1)) == date(2026, 1, 2)
    for bad in ({"rooms": {"r": "t"}, "loft_since": "soon"}, {"rooms": {}}, {"rooms": {"r": "t"}, "ceiling_m": 1.0}, {"rooms": {"r": "t"}, "boiler_efficiency": 1.2}):
        with pytest.raises(ValueError):
            Home(**bad)
    assert HeatLoss().bounds == (10.0, 1500.0) and Meter().coverage == 0.9


def test_rooms_of_thermostats(spark):
    thermostats = spark.createDataFrame([("climate.den", "d1", "den"), ("climate.hall", "d2", "hall"), ("climate.new", None, None)], "entity_id string, device_id string, area string")
    entities = spark.createDataFrame(
        [("sensor.b_ema_temperature", "d1", "den"), ("sensor.a_ema_temperature", "d1", "den"), ("sensor.t", "d1", "den"), ("sensor.den_heating_power", "d9", "den")]
        + [("sensor.h1_heating_power", "d2", "hall"), ("sensor.h2_heating_power", "d2", "hall"), ("sensor.c_ema_temperature", "d3", "hall")],
        "entity_id string, device_id string, area string",
    )
    found = {r.entity_id: (r.area, r.temp_series, r.heat_series) for r in report.suggested_rooms(thermostats, entities).collect()}
    assert found == {"climate.den": ("den", "sensor.a_ema_temperature", "sensor.den_heating_power"), "climate.hall": ("hall", None, None), "climate.new": (None, None, None)}
    names = spark.createDataFrame([("Living room",), ("living-room",), ("??",), ("den",)], "room string")
    assert {tuple(r) for r in report.invalid_rooms(names).collect()} == {("Living room", "duplicate"), ("living-room", "duplicate"), ("??", "empty")}


def test_streaming_means_and_upserts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("s", "rest", 0, 1.0), ("s", "rest", 60, 3.0)], "series_id string, source string, sec long, value double").write.parquet(source)
    stream = spark.readStream.schema("series_id string, source string, sec long, value double").parquet(source)
    query = ingest.upsert_stream(stream, str(tmp_path / "cache"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2
    hours = ingest.hourly_means(stream.withColumn("ts", F.timestamp_seconds("sec")))
    told = hours.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    told.awaitTermination(60)
    assert [(r["mean"], r.n) for r in spark.table("hours").collect()] == [(2.0, 2)]
