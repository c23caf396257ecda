"""Homes by their own configuration: pruned scans, forms, zones, windows of nights, lofts, the nested report."""

import glob
import shutil
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from emberlane.operators import air, cooling, meters
from emberlane.plans import analyses, report, whole
from emberlane.sources import homes, scratch, statistics
from tests.test_telemetry import DAYS, sec, season

SCAN = "series_id string, sec long, mean double, sum double, unit string"
FORM = "home string, timezone string, floor_area_m2 string, ceiling_m string, outdoor_ppm string, away_litres string, boiler_efficiency string, window_days string, loft_since string, gas_tariff string, gas_unit string, power_tariff string, power_unit string"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Forty series over three months, all in one table."""
    units = {0: "°F", 1: "°C", 2: "K", 3: "stone"}
    rows = [(f"s{k}", sec(2026, m, d, 5), 50.0 + k, 2.0 * d, units[k % 4]) for k in range(40) for m in (1, 2, 3) for d in range(1, 29)]
    path = str(tmp_path_factory.mktemp("scan") / "statistics")
    statistics.land(spark.createDataFrame(rows, SCAN), path, buckets=8)
    return path


def test_scan_reads_the_wanted_series_and_range_in_its_units(spark, landed):
    wanted = {"s0": "temperature", "s2": "temperature", "s3": "temperature", "s5": "volume", "gone": "energy"}
    got = statistics.scan(spark, landed, wanted, sec(2026, 2, 3), sec(2026, 2, 5), buckets=8).collect()
    assert {(r.series_id, r.sec) for r in got} == {(s, sec(2026, 2, d, 5)) for s in ("s0", "s2", "s3", "s5") for d in (3, 4)}
    first = {r.series_id: r for r in got if r.sec == sec(2026, 2, 3, 5)}
    assert first["s0"].mean == pytest.approx(10.0) and first["s2"].mean == pytest.approx(52 - 273.15)
    assert first["s3"].mean is None and first["s5"].sum is None  # no such unit of temperature or volume
    assert statistics.scan(spark, landed, {"s0": "temperature"}, sec(2026, 2, 3, 5), sec(2026, 2, 3, 5), buckets=8).collect() == []


def test_plan_prunes_folders_and_pushes_ids_and_stamps(spark, landed):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    out = statistics.scan(spark, landed, {"s1": "temperature"}, sec(2026, 2, 3), sec(2026, 2, 5), buckets=8)
    [scan] = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line and "month" in line]
    filters = scan.split("PartitionFilters: ")[1].split("], PushedFilters: ")
    assert "month" in filters[0] and "202602" in filters[0] and "bucket" in filters[0]
    assert "EqualTo(series_id,s1)" in filters[1] or "In(series_id" in filters[1]
    assert "GreaterThanOrEqual(sec" in filters[1] and "LessThan(sec" in filters[1]
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("as_table", [False, True])
def test_only_touched_files_are_read(spark, landed, tmp_path, as_table):
    """All other files are broken, so reading one would fail."""
    copy = str(tmp_path / "copy")
    shutil.copytree(landed, copy)
    bucket = spark.range(1).select(statistics.bucket_of(F.lit("s1"), 8)).first()[0]
    for file in glob.glob(f"{copy}/*/*/*.parquet"):
        if not (f"bucket={bucket}/" in file and "month=202603" in file):
            with open(file, "wb") as f:
                f.write(b"broken")
    wanted = {"s1": "temperature"} if not as_table else spark.createDataFrame([("s1", "temperature")], "series_id string, quantity string")
    assert statistics.scan(_Fixed(spark, landed), copy, wanted, sec(2026, 3, 1), sec(2026, 4, 1), buckets=8).count() == 28


class _Fixed:
    """A session whose reader takes the schema from a sound copy, as inference may open any file."""

    def __init__(self, spark, sound):
        self.spark, self.sound = spark, sound
        self.createDataFrame, self.read = spark.createDataFrame, self

    def parquet(self, path):
        return self.spark.read.schema(self.spark.read.parquet(self.sound).schema).parquet(path)


def test_forms(spark):
    none = [None] * 12
    rows = [
        ("plain", *none),
        ("full", "Asia/Tokyo", "80", "2.5", "410", "0", "0.9", "90", "2026-01-02", "5.25", "p/kWh", "0.3", "GBP/kWh"),
        ("zone", "Mars/Base", *none[1:]),
        ("text", None, "big", *none[2:]),
        ("low", None, None, "1.0", *none[3:]),
        ("date", *none[:7], "2026-13-01", *none[8:]),
        ("blank", " ", "", " ", *none[3:]),
        ("unit", *none[:8], "5", "EUR/kWh", "4", "£ / MWh"),
        ("nan", None, "NaN", *none[2:]),
    ]
    got = {r.home: r for r in homes.configured(spark.createDataFrame(rows, FORM), ["home"]).collect()}
    assert {k: r.problem for k, r in got.items() if r.problem} == {
        "zone": "timezone: unknown", "text": "floor_area_m2: no number", "low": "ceiling_m: not in 1.8..10", "date": "loft_since: no date", "nan": "floor_area_m2: no number",
    }
    assert all(got[k].zone is None and got[k].windows is None and got[k].window_days is None for k in ("zone", "text", "low", "date"))
    plain, full = got["plain"], got["full"]
    assert (plain.zone, plain.floor_area_m2, plain.ceiling_m, plain.away_litres, plain.boiler_efficiency, plain.window_days, plain.windows) == ("Europe/London", None, 2.4, 50.0, 0.88, 365, [60, 120, 365])
    assert (full.zone, full.away_litres, full.windows, full.loft_since, full.gas_rate, full.power_rate) == ("Asia/Tokyo", 0.0, [60, 90], date(2026, 1, 2), 0.0525, 0.3)
    assert got["blank"].problem is None and got["unit"].gas_rate is None and got["unit"].power_rate == 0.004


def test_days_of_homes_in_different_zones(spark):
    """Clocks change on 8 March in New York and on 29 March in London; India's never do."""
    begun = int(datetime(2026, 3, 6, tzinfo=timezone.utc).timestamp())
    zones = {"a": "America/New_York", "b": "Europe/London", "c": "Asia/Kolkata"}
    rows = [(h, z, begun + k * 3600, float(k)) for h, z in zones.items() for k in range(26 * 24)]
    readings = spark.createDataFrame(rows, "home string, zone string, sec long, value double")
    by = ["home", "zone"]
    days = meters.daily(meters.steps(readings, by), by, F.col("zone"))
    hours = {(r.home, str(r.d)): r.hours for r in days.collect()}
    assert [hours[h, "2026-03-08"] for h in "abc"] == [23, 24, 24]
    assert [hours[h, "2026-03-29"] for h in "abc"] == [24, 23, 24]
    longs = {(r.home, str(r.d)): r.n for r in days.select("home", "d", meters.day_hours(F.col("d"), F.col("zone")).alias("n")).collect()}
    assert longs["a", "2026-03-08"] == 23 and longs["b", "2026-03-08"] == 24 and longs["b", "2026-03-29"] == 23


def test_nights_by_their_windows(spark):
    today = date(2026, 3, 1)
    night = lambda home, room, ago, tau, why=None: (home, room, today - timedelta(days=ago), tau, why)
    rows = [night("a", "r", k, 10.0 + k) for k in (5, 50, 70, 100, 110)] + [night("a", "few", 300, 50.0), night("a", "bad", 5, 9.0, "weak fit"), night("b", "r", 95, 7.0), night("b", "r", 10, 3.0)]
    fits = spark.createDataFrame(rows, "home string, room string, d date, tau_h double, rejection_reason string")
    windows = spark.createDataFrame([("a", today, [60, 120, 365]), ("b", today, [60, 90])], "home string, today date, windows array<int>")
    rooms = spark.createDataFrame([("a", "r"), ("a", "few"), ("a", "bad"), ("b", "r"), ("c", "none")], "home string, room string")
    got = {(r.home, r.room): (r.tau_median_h, r.nights_fitted, r.window_days) for r in cooling.in_windows(fits, ["home"], windows, rooms).collect()}
    assert got == {("a", "r"): (80.0, 5, 120), ("a", "few"): (50.0, 1, 365), ("a", "bad"): (None, 0, None), ("b", "r"): (3.0, 1, 90), ("c", "none"): (None, 0, None)}


def test_a_moved_loft_sensor_counts_from_its_move(spark):
    hours = [(d, h) for d in range(1, 29) for h in range(24)]
    frame = lambda f: spark.createDataFrame([("a", "UTC", sec(2026, 2, d, h), float(f(d, h))) for d, h in hours], "home string, zone string, sec long, value double")
    inside, out = frame(lambda d, h: 20), frame(lambda d, h: 5)
    loft = frame(lambda d, h: 20 + h * 0.1 if d < 15 else 8 + h * 0.01 + d * 0.001)
    home = lambda since: spark.createDataFrame([("a", "UTC", date(2026, 3, 1), 60, since), ("b", "UTC", date(2026, 3, 1), 60, None)], "home string, zone string, today date, window_days int, loft_since date")
    humid = frame(lambda d, h: d)
    of = lambda since: {r.home: r for r in air.loft_report(inside, loft, out, home(since), ["home", "zone"], F.col("zone"), humid).collect()}
    mixed, moved = of(None), of(date(2026, 2, 15))
    assert mixed["a"].ratio is None and mixed["a"].unavailable_reason == "not enough cold night hours"
    assert 0.2 < moved["a"].ratio < 0.21 and moved["a"].hours_used == 14 * 5 and (moved["a"].window_days, moved["a"].humidity_pct) == (60, 28.0)
    assert moved["b"].ratio is None and moved["b"].unavailable_reason


CONFIGURED = "home string, zone string, floor_area_m2 double, ceiling_m double, outdoor_ppm double, away_litres double, boiler_efficiency double, window_days int, loft_since date, gas_rate double, power_rate double, problem string, has_water boolean, has_power boolean"


def nested(spark, rows, configs):
    days = scratch.written(report.complete_days(spark.createDataFrame(rows, DAYS), ["home"]))
    table = spark.createDataFrame(configs, CONFIGURED)
    rooms = spark.createDataFrame([("a", "den", 15.0, 4, date(2026, 3, 1), 60), ("a", "hall", None, 0, None, None)], "home string, room string, tau_median_h double, nights_fitted long, last_night date, window_days int")
    ach = spark.createDataFrame([("a", 0.3, 12, 420.0, 2, "percentile")], "home string, ach double, windows long, baseline double, sensors long, baseline_source string")
    loft = spark.createDataFrame([("a", 0.2, "v", 20, 365, 0.1, 0.0, 60.0)], "home string, ratio double, verdict string, hours_used long, window_days int, iqr double, out_of_range_pct double, humidity_pct double")
    litres = spark.createDataFrame([("a", 18.0, 45.0, True)], "home string, wh_per_litre double, hot_pct double, usable boolean")
    return {r.home: r for r in whole.whole_report(days, table, ["home"], rooms, ach, loft, litres).collect()}, days


def config(home, problem=None, **more):
    values = dict(zone="UTC", floor_area_m2=100.0, ceiling_m=2.4, outdoor_ppm=None, away_litres=50.0, boiler_efficiency=0.9, window_days=365, loft_since=None, gas_rate=0.07, power_rate=0.25)
    values = {k: (None if problem else more.get(k, v)) for k, v in values.items()}
    return (home, *values.values(), problem, more.get("has_water", True), more.get("has_power", True))


def test_the_nested_report(spark):
    first = date(2025, 9, 1)
    rows = season(first, 200) + season(first, 200, "cold") + [("bad", first, True, 5.0, 15.0, 2.0, None, None, None, None)] * 1
    got, days = nested(spark, rows, [config("a"), config("cold", boiler_efficiency=0.8, has_water=False, gas_rate=None), config("bad", "ceiling_m: not in 1.8..10"), config("empty")])
    assert set(got) == {"a", "cold", "bad", "empty"}
    a, cold = got["a"], got["cold"]
    assert set(a.rooms) == {"den", "hall"} and a.rooms["den"].tau_median_h == 15.0 and a.rooms["hall"] is None
    assert a.hlc.status == "valid" and a.hlc.boiler_efficiency_used == 0.9 and a.hlc.hlc_w_per_k_per_m2 == pytest.approx(a.hlc.hlc_w_per_k / 100)
    assert a.losses.ventilation_w_per_k == pytest.approx(0.3 * 240 * 0.335) and a.losses.fabric_w_per_k + a.losses.ventilation_w_per_k == pytest.approx(a.hlc.delivered_hlc_w_per_k)
    assert a.dhw.kwh_per_day == 10.0 and a.dhw.wh_per_litre == 18.0 and a.loft.ratio == 0.2 and a.water_status.configured and a.electricity_status.usable_days is None
    assert cold.hlc.fuel_input_hlc_w_per_k == pytest.approx(a.hlc.fuel_input_hlc_w_per_k) and cold.hlc.hlc_w_per_k < a.hlc.hlc_w_per_k
    assert cold.water_usage is None and not cold.water_status.configured and cold.dhw.cost_per_day is None and cold.losses is None and cold.loft is None
    assert got["bad"].config_problem == "ceiling_m: not in 1.8..10" and got["bad"].hlc is None and got["bad"].dhw is None and got["empty"].hlc is None
    # the same values as the reports of homes that share a configuration
    flat = {r.home: r for r in report.composite(days, ["home"], 0.9, 100.0, 0.07, 0.25).collect()}["a"]
    assert round(a.hlc.hlc_w_per_k, 1) == flat.hlc_w_per_k and round(a.hlc.hlc_ci_low_w_per_k, 1) == flat.hlc_ci_low and a.electricity.kwh_per_day == pytest.approx(flat.elec_kwh_per_day, abs=0.01)
    assert round(a.usage.dhw_kwh_per_day_7d, 2) == flat.gas_hot_7d and a.water_usage.litres_per_day_7d == flat.water_litres_7d


def test_days_are_read_once_and_shuffled_once(spark):
    days = scratch.written(report.complete_days(spark.createDataFrame(season(date(2025, 9, 1), 50), DAYS), ["home"]))
    plan = analyses.analyses(analyses.uniform(days), ["home"])._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[-1]
    assert final.count("FileScan") == 1 and final.count("Exchange hashpartitioning") == 1 and "Join" not in final


def test_homes_without_a_baseline_keep_their_row_of_gas_use(spark):
    rows = season(date(2025, 9, 1), 200) + [("b", date(2025, 9, 1) + timedelta(days=k), False, 50.0, 2.0, 18.0, None, None, None, None) for k in range(60)]
    days = report.complete_days(spark.createDataFrame(rows, DAYS), ["home"])
    got = {r.home: r for r in report.gas_use(days, ["home"], 365, 0.07).collect()}
    assert set(got) == {"a", "b"} and got["b"].hot_7d is None and got["b"].unavailable_reason and got["a"].unavailable_reason is None
    hot = {r.home: r for r in report.hot_water(days, ["home"], 365, 0.07).collect()}
    assert hot["b"].unavailable_reason == "0 of 7 days without heating"
