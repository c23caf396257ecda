"""Registered queries of homes that each have a configuration of their own, and of the pruned scan."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import air, cooling, daily, meters, ranks
from ..sources import homes as forms
from ..sources import statistics
from ..sources.scratch import kept, shared_folder, written
from ..thresholds import Meter
from .adapter import H, HOURS, LOCAL, hourly, house_hours, series_of, table
from .queries import FIT_CTES, FIT_REASON, HOME, TAU, ZONED, house_rooms, night_fits, query, r, tau_sql
from .report_queries import GAS_WATER, REPORT_DAYS, _todays, air_changes, air_sql, gas_by_litres, recent_sql, report_days, split_sql, water_sql
from .whole import whole_report

#: Units in which the series of events are taken to arrive; barrels are no unit of volume here.
SERIES = {"view": ("temperature", "°F"), "error": ("temperature", "K"), "purchase": ("energy", "MWh"), "signup": ("volume", "barrel")}
SINCE, UNTIL = 1_704_672_000, 1_706_745_600  # 8 January to 1 February 2024


@query(
    f"""WITH {H},
u(series_id, quantity, f, o) AS (VALUES ('view', 'temperature', 5 / 9.0::DOUBLE, -160 / 9.0::DOUBLE), ('error', 'temperature', 1.0, -273.15::DOUBLE), ('purchase', 'energy', 1000.0, 0.0),
  ('signup', 'volume', NULL, NULL))
SELECT series_id, quantity, sec, round(mean * f + o, 8) AS mean, round(sum(inc) OVER (PARTITION BY series_id ORDER BY sec) * f, 8) AS sum
FROM h JOIN u USING (series_id) QUALIFY sec >= {SINCE} AND sec < {UNTIL}"""
)
def stats_scan(spark, sf_dir):
    """Events of one configuration's series in a range of time, in its units, out of a table of all of them."""
    unit = F.coalesce(*(F.when(F.col("series_id") == k, u) for k, (_, u) in SERIES.items()), F.lit("%"))
    rows = hourly(spark, sf_dir).select("series_id", "sec", "mean", "inc", unit.alias("unit"))
    rows = rows.withColumn("sum", meters.running(rows, ["series_id"], "inc")).drop("inc")
    path = kept(spark, f"{shared_folder(spark)}/emberlane-statistics-{uuid.uuid4().hex}")
    statistics.land(rows, path)
    out = statistics.scan(spark, path, {k: q for k, (q, _) in SERIES.items()}, SINCE, UNTIL)
    return out.select("series_id", "quantity", "sec", r("mean"), r("sum"))


def customer_forms(spark, sf_dir: str) -> DataFrame:
    """Forms that customers are taken to have filled in, some of them wrongly."""
    key = F.col("c_custkey")
    pick = lambda by, cases, other: reduce(lambda c, k: c.when(key % by == k, cases[k]), cases, F.when(F.lit(False), other)).otherwise(other)
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "customer").select(
        key.alias("home"), pick(5, {0: "Europe/Paris", 1: "America/New_York", 2: " ", 3: "Asia/Tokyo"}, F.when(key % 10 == 4, "Mars/Base")).alias("timezone"),
        pick(10, {0: none, 1: F.lit("large")}, text(F.col("c_acctbal") / 8)).alias("floor_area_m2"), pick(7, {0: F.lit("3.1")}, none).alias("ceiling_m"),
        pick(6, {0: F.lit("420")}, none).alias("outdoor_ppm"), text(key % 300).alias("away_litres"), text((key % 60) / 100 + 0.45).alias("boiler_efficiency"),
        text(key % 800).alias("window_days"), pick(7, {1: F.lit("2024-13-01"), 2: F.lit("2024-02-03")}, none).alias("loft_since"),
        text(key % 40).alias("gas_tariff"), pick(4, {0: "p/kWh", 1: "GBP / kWh", 2: "GBP/MWh"}, F.lit("EUR/kWh")).alias("gas_unit"),
        pick(9, {0: none}, text(key % 50)).alias("power_tariff"), F.lit("pence/kWh").alias("power_unit"),
    )


@query(
    """WITH f AS (
  SELECT c_custkey AS home, c_custkey AS k,
    CASE c_custkey % 5 WHEN 0 THEN 'Europe/Paris' WHEN 1 THEN 'America/New_York' WHEN 3 THEN 'Asia/Tokyo' WHEN 4 THEN CASE WHEN c_custkey % 10 = 4 THEN 'Mars/Base' END END AS zone,
    CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'large' ELSE (c_acctbal / 8)::VARCHAR END AS area, CASE WHEN c_custkey % 7 = 0 THEN 3.1::DOUBLE ELSE 2.4::DOUBLE END AS ceiling,
    CASE WHEN c_custkey % 6 = 0 THEN 420.0::DOUBLE END AS ppm, (c_custkey % 300)::DOUBLE AS away, (c_custkey % 60) / 100 + 0.45::DOUBLE AS eff, (c_custkey % 800)::INT AS win,
    CASE c_custkey % 7 WHEN 1 THEN '2024-13-01' WHEN 2 THEN '2024-02-03' END AS since,
    CASE c_custkey % 4 WHEN 0 THEN c_custkey % 40 / 100 WHEN 1 THEN c_custkey % 40 WHEN 2 THEN c_custkey % 40 / 1000 END::DOUBLE AS gas, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 50 / 100 END::DOUBLE AS power
  FROM customer),
p AS (
  SELECT *, CASE WHEN zone = 'Mars/Base' THEN 'timezone: unknown' WHEN area IS NOT NULL AND try_cast(area AS DOUBLE) IS NULL THEN 'floor_area_m2: no number'
    WHEN try_cast(area AS DOUBLE) NOT BETWEEN 1 AND 2000 THEN 'floor_area_m2: not in 1..2000' WHEN eff NOT BETWEEN 0.5 AND 1 THEN 'boiler_efficiency: not in 0.5..1'
    WHEN win NOT BETWEEN 30 AND 730 THEN 'window_days: not in 30..730' WHEN since IS NOT NULL AND try_cast(since AS DATE) IS NULL THEN 'loft_since: no date' END AS problem
  FROM f)
SELECT home, CASE WHEN problem IS NULL THEN coalesce(zone, 'Europe/London') END AS zone, CASE WHEN problem IS NULL THEN round(try_cast(area AS DOUBLE), 8) END AS floor_area_m2,
  CASE WHEN problem IS NULL THEN ceiling END AS ceiling_m, CASE WHEN problem IS NULL THEN ppm END AS outdoor_ppm, CASE WHEN problem IS NULL THEN away END AS away_litres,
  CASE WHEN problem IS NULL THEN round(eff, 8) END AS boiler_efficiency, CASE WHEN problem IS NULL THEN win END AS window_days, CASE WHEN problem IS NULL THEN since::DATE END AS loft_since,
  CASE WHEN problem IS NULL THEN round(gas, 8) END AS gas_rate, CASE WHEN problem IS NULL THEN round(power, 8) END AS power_rate,
  CASE WHEN problem IS NULL THEN CASE WHEN win > 365 THEN '60,120,365,' WHEN win > 120 THEN '60,120,' WHEN win > 60 THEN '60,' ELSE '' END || win END AS windows, problem
FROM p""".replace("since::DATE", "try_cast(since AS DATE)")
)
def home_config(spark, sf_dir):
    out = forms.configured(customer_forms(spark, sf_dir), HOME)
    rounded = {c: F.round(c, 8) for c in ("floor_area_m2", "boiler_efficiency", "gas_rate", "power_rate")}
    return out.withColumns(rounded | {"windows": F.array_join("windows", ",")})


@query(
    f"""WITH {HOURS},
g AS (SELECT home, zone, sec, sec - lag(sec) OVER w AS gap, gas FROM hh WINDOW w AS (PARTITION BY home ORDER BY sec)),
n AS (SELECT home, zone, {LOCAL.format('sec')}::DATE AS d, sum(gas) AS total, min(gas) AS least, count(*) AS hours FROM g WHERE gap <= 5400 GROUP BY 1, 2, 3),
x AS (SELECT *, (epoch(timezone(zone, (d + 1)::TIMESTAMP)) - epoch(timezone(zone, d::TIMESTAMP))) / 3600 AS long FROM n)
SELECT home, zone, d, round(total, 8) AS total, round(least, 8) AS least, hours, hours >= (long - 1) * 0.9::DOUBLE AS complete, long::BIGINT AS day_hours FROM x"""
)
def zoned_days(spark, sf_dir):
    """Days of homes in zones whose clocks change on different days, in one query."""
    hours = house_hours(spark, sf_dir)
    readings = hours.select("home", "zone", "sec", meters.running(hours, HOME, "gas").alias("value"))
    days = meters.daily(meters.steps(readings, ZONED, Meter()), ZONED, F.col("zone"))
    return days.select("home", "zone", "d", r("total"), r("least"), "hours", "complete", meters.day_hours(F.col("d"), F.col("zone")).alias("day_hours"))


#: Configuration of the homes that the tables make, and one that isn't sound.
FIELDS = "home string, timezone string, floor_area_m2 string, ceiling_m string, outdoor_ppm string, away_litres string, boiler_efficiency string, window_days string, loft_since string, gas_tariff string, gas_unit string, power_tariff string, power_unit string, has_water boolean, has_power boolean"
HOUSES = [
    ("A", "America/New_York", "85", "2.5", None, "40", "0.9", "200", None, "7", "p/kWh", "27", "p/kWh", False, True),
    ("N", None, "120", None, "415", None, None, None, "2001-06-01", "0.07", "GBP/kWh", "0.3", "EUR/kWh", True, True),
    ("R", "Asia/Kolkata", None, "2.6", None, "0", "0.8", "90", None, "65", "GBP/MWh", "25", "p/kWh", True, True),
    ("X", None, "80", "1.0", None, None, None, None, None, None, None, None, None, True, True),
]
CONFIG = """cf(home, zone, area, ceiling, ppm, away, eff, win, loft_since, gas, power, has_water) AS (VALUES
  ('A', 'America/New_York', 85.0::DOUBLE, 2.5::DOUBLE, NULL::DOUBLE, 40.0::DOUBLE, 0.9::DOUBLE, 200, NULL::DATE, 0.07::DOUBLE, 0.27::DOUBLE, false),
  ('N', 'Europe/London', 120.0, 2.4, 415.0, 50.0, 0.88, 365, DATE '2001-06-01', 0.07, NULL, true),
  ('R', 'Asia/Kolkata', NULL, 2.6, NULL, 0.0, 0.8, 90, NULL, 0.065, 0.25, true)),
hs AS (SELECT cf.*, today FROM cf JOIN homes USING (home))"""


def house_config(spark, days: DataFrame) -> DataFrame:
    """(home, zone, ..., windows, problem, has_water, has_power, today)."""
    given = spark.createDataFrame(HOUSES, FIELDS)
    return forms.configured(given, HOME).join(given.select("home", "has_water", "has_power"), "home").join(_todays(days), "home", "left")


def since_window(hours: DataFrame, homes: DataFrame) -> DataFrame:
    """Hours of each home from its longest window's first day on."""
    begun = homes.where("today is not null").select("home", F.date_sub("today", F.col("window_days")).alias("__since"))
    return hours.join(begun, "home").where(meters.local_time(F.col("sec"), F.col("zone")).cast("date") >= F.col("__since")).drop("__since")


def _rooms(hours: DataFrame, homes: DataFrame) -> DataFrame:
    every = homes.select("home").crossJoin(F.broadcast(house_rooms(hours.sparkSession).select("room")))  # two rooms, of all homes
    return cooling.in_windows(written(night_fits(hours).drop("zone")), HOME, homes.where("today is not null").select("home", "today", "windows"), every)


TAU_WINDOWS = """
wd AS (SELECT home, today, unnest(list_append(list_filter([60, 120, 365], lambda w: w < win), win)) AS w, win FROM hs),
ew AS (
  SELECT tf.home, room, w, win, median(tau_h) AS tau, count(*) AS n, max(d) AS last
  FROM tf JOIN wd ON wd.home = tf.home AND today - d <= w WHERE rejection_reason IS NULL GROUP BY 1, 2, 3, 4),
pw AS (SELECT *, row_number() OVER (PARTITION BY home, room ORDER BY w) AS k FROM ew WHERE n >= 3 OR w = win),
rooms AS (SELECT x.home, room.room, tau, coalesce(n, 0) AS n, last, w FROM (SELECT home FROM hs UNION ALL SELECT 'X') x CROSS JOIN (VALUES ('room_a'), ('room_b')) room(room)
  LEFT JOIN pw ON pw.home = x.home AND pw.room = room.room AND k = 1)"""
#: Nights of the longest window, by each home's configuration.
HOME_TAU = f"{REPORT_DAYS}, {CONFIG}, {HOURS}," + tau_sql(" JOIN hs USING (home) WHERE d >= today - win").replace("SELECT home, room, d, count(*) AS n_points", "SELECT qn.home, room, d, count(*) AS n_points")


@query(f"WITH {HOME_TAU},{TAU_WINDOWS} SELECT home, room, tau AS tau_median_h, n AS nights_fitted, last AS last_night, w AS window_days FROM rooms")
def tau_windows(spark, sf_dir):
    days = report_days(spark, sf_dir)
    homes = written(house_config(spark, days))
    return _rooms(written(since_window(house_hours(spark, sf_dir), homes)), homes)


LOFTS = f"""
lf AS (
  SELECT hh.home, hh.zone, sec, room_a, room_b, outdoor, loft, today, win, greatest(today - win, coalesce(loft_since, today - win)) AS since,
    count(loft) OVER w AS n, max(loft) OVER w - min(loft) OVER w AS s
  FROM hh JOIN hs USING (home) WINDOW w AS (PARTITION BY hh.home ORDER BY sec ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
lx AS (SELECT home, win, (loft - outdoor) / ((room_a + room_b) / 2 - outdoor) AS r FROM lf
  WHERE NOT (n = 24 AND s < 0.05) AND {LOCAL.format('sec')}::DATE >= since AND hour({LOCAL.format('sec')}) BETWEEN 1 AND 5 AND (room_a + room_b) / 2 - outdoor > 6),
lk0 AS (SELECT *, row_number() OVER (PARTITION BY home ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY home) AS n FROM lx),
lo AS (SELECT home, max(win) AS win, median(r) AS ratio, count(*) AS n, max(r) FILTER (k = 3 * n // 4) - max(r) FILTER (k = n // 4) AS iqr,
   avg(CASE WHEN r BETWEEN 0 AND 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) * 100 AS outside FROM lk0 GROUP BY 1),
lh AS (SELECT hh.home, max_by(humidity, sec) AS humidity FROM hh JOIN hs USING (home)
  WHERE humidity IS NOT NULL AND {LOCAL.format('sec').replace('(zone,', '(hh.zone,')}::DATE >= greatest(today - win, coalesce(loft_since, today - win)) GROUP BY 1),
loft AS (SELECT lo.*, humidity FROM lo LEFT JOIN lh USING (home) WHERE n >= 12 AND ratio BETWEEN 0 AND 1 AND iqr <= 0.5 AND outside <= 20)"""


def _loft(hours: DataFrame, homes: DataFrame) -> DataFrame:
    of = lambda *names: series_of(hours, *names)
    inside = daily.hourly_over_any(of("room_a", "room_b"), ["room_a", "room_b"], ZONED)
    known = homes.where("today is not null").select("home", "zone", "today", "window_days", "loft_since")
    return air.loft_report(inside, of("loft").drop("series_id"), of("outdoor").drop("series_id"), known, ZONED, F.col("zone"), of("humidity").drop("series_id")).drop("zone")


@query(
    f"""WITH {REPORT_DAYS}, {CONFIG}, {HOURS},{LOFTS}
SELECT hs.home, round(ratio, 3) AS ratio, CASE WHEN ratio > 0.5 THEN 'loft follows the house' WHEN ratio > 0.25 THEN 'between house and outdoors' WHEN ratio IS NOT NULL THEN 'loft follows outdoors' END AS verdict,
  n AS hours_used, loft.win AS window_days, round(iqr, 3) AS iqr, round(outside, 1) AS out_of_range_pct, round(humidity, 1) AS humidity_pct,
  CASE WHEN ratio IS NULL THEN 'not enough cold night hours' END AS unavailable_reason
FROM hs LEFT JOIN loft USING (home)"""
)
def report_loft(spark, sf_dir):
    homes = written(house_config(spark, report_days(spark, sf_dir)))
    out = _loft(written(house_hours(spark, sf_dir)), homes)
    return out.withColumns({"ratio": F.round("ratio", 3), "iqr": F.round("iqr", 3), "out_of_range_pct": F.round("out_of_range_pct", 1), "humidity_pct": F.round("humidity_pct", 1)})


def home_report(spark, sf_dir: str) -> DataFrame:
    """The nested report of the homes, by their own configuration."""
    days = report_days(spark, sf_dir)
    homes = written(house_config(spark, days))
    all_hours = written(house_hours(spark, sf_dir))
    near = since_window(all_hours, homes)
    efficiency = homes.select("home", "boiler_efficiency")
    litres = gas_by_litres(near.select("*"), 1.0).join(efficiency, "home").withColumn("hot_pct", F.least(F.lit(100.0), F.col("wh_per_litre") * F.col("boiler_efficiency") / 34.8 * 100)).drop("boiler_efficiency")
    changes = air_changes(all_hours, homes.where("today is not null").select("home", "today", "window_days", "outdoor_ppm"))
    return whole_report(days, homes, HOME, _rooms(written(near), homes), changes, _loft(all_hours, homes), litres)


def flat(report: DataFrame) -> DataFrame:
    """Structs as columns with a prefix, and the rooms as text, in order of name."""
    columns = []
    for field in report.schema:
        if field.dataType.typeName() == "struct":
            columns += [F.col(f"{field.name}.{c}").alias(f"{field.name}_{c}") for c in field.dataType.names]
        elif field.dataType.typeName() == "map":
            line = lambda e: F.when(e["value"].isNull(), F.concat(e["key"], F.lit(":none"))).otherwise(F.format_string("%s:%.3f:%d:%s:%d", e["key"], e["value"]["tau_median_h"], e["value"]["nights_fitted"], e["value"]["last_night"].cast("string"), e["value"]["window_days"]))
            columns.append(F.array_join(F.array_sort(F.transform(F.map_entries(field.name), line)), ",").alias(field.name))
        else:
            columns.append(F.col(field.name))
    return report.select(columns)


_KINDS = {"raw": "q > 0.5 AND delta_t > 4", "net": "q > 0.5 AND delta_t > 4 AND q - hot > 0"} | {str(w): f"q > 0.5 AND delta_t > 4 AND q - hot > 0 AND model_day - d <= {w} AND win > {w}" for w in (60, 120)}
HOME_REPORT = (
    f"""WITH {HOME_TAU},{TAU_WINDOWS},{LOFTS},
cw AS (
  SELECT rw.* REPLACE (CASE WHEN has_water THEN water END AS water), cf.* EXCLUDE (home, has_water, zone), has_water FROM rw JOIN cf USING (home)),
wn AS (SELECT * FROM cw WHERE today - d <= win),
md AS (SELECT home, max(d) AS model_day FROM wn WHERE delta_t > 4 AND q > 0.5 AND (heat_pct IS NULL OR heat_pct > 1) GROUP BY 1),
lk AS (SELECT cw.*, model_day FROM cw LEFT JOIN md USING (home) WHERE model_day IS NULL OR d <= model_day),
ln AS (SELECT * FROM lk WHERE coalesce(model_day, today) - d <= win)"""
    + water_sql("cw", "wn", "_r", "away") + split_sql("cw", "_r") + water_sql("lk", "ln", "_l", "away") + split_sql("ln", "_l")
    + ",\nax AS (SELECT ln.*, coalesce(hot_kwh, 0) AS hot FROM ln LEFT JOIN (SELECT home, d, hot_kwh FROM a3_l) USING (home, d)),\np AS ("
    + " UNION ALL ".join(f"SELECT home || '|{k}' AS home, d, delta_t AS x, q - {'0' if k == 'raw' else 'hot'} AS y FROM ax WHERE {where}" for k, where in _KINDS.items())
    + ")" + FIT_CTES
    + f""",
ft AS (SELECT split_part(home, '|', 1) AS home, split_part(home, '|', 2) AS fit, k.* EXCLUDE (home), {FIT_REASON} AS why FROM k),
fr AS (SELECT * FROM ft WHERE fit = 'raw' AND why IS NULL),
fn AS (SELECT ft.* FROM ft JOIN model_l USING (home) WHERE fit = 'net' AND why IS NULL),
sh AS (SELECT home, min({{'w': fit::INT, 'hlc': hlc, 'n': n}}) AS s FROM ft WHERE fit NOT IN ('raw', 'net') AND why IS NULL GROUP BY 1),
be AS (
  SELECT fr.home, fr.hlc AS raw_hlc, fr.r2 AS raw_r2, fn.home IS NOT NULL AS corrected,
    UNNEST(CASE WHEN fn.home IS NOT NULL THEN {{'hlc': fn.hlc, 'slope': fn.slope, 'se': fn.se, 'r2': fn.r2, 'n': fn.n, 'r1': fn.r1, 'vif': fn.vif, 'intercept': fn.intercept}}
      ELSE {{'hlc': fr.hlc, 'slope': fr.slope, 'se': fr.se, 'r2': fr.r2, 'n': fr.n, 'r1': fr.r1, 'vif': fr.vif, 'intercept': fr.intercept}} END)
  FROM fr LEFT JOIN fn USING (home)),
hl AS (
  SELECT be.home, be.hlc * eff AS hlc_w_per_k, (slope - 1.96 * se) * 1000 / 24 * eff AS hlc_ci_low_w_per_k, (slope + 1.96 * se) * 1000 / 24 * eff AS hlc_ci_high_w_per_k, r2 AS r_squared,
    be.n AS days_used, r1 AS residual_autocorrelation, be.n / vif AS effective_independent_days, -intercept * eff AS free_gains_kwh_per_day, -intercept * eff * 1000 / 24 AS free_gains_w,
    -intercept AS fuel_input_free_gains_kwh_per_day, intercept AS regression_intercept_kwh_per_day, raw_hlc AS fuel_input_hlc_w_per_k, raw_r2 AS fuel_input_r_squared,
    be.hlc AS space_heating_fuel_input_hlc_w_per_k, be.hlc * eff AS delivered_hlc_w_per_k, eff AS boiler_efficiency_used, win AS window_days,
    CASE WHEN be.n >= 30 THEN 'valid' ELSE 'provisional' END AS status, model_day AS model_data_through, model_l.baseline AS dhw_baseline_kwh_per_day, model_l.days_used AS dhw_baseline_days_used,
    be.hlc * eff / area AS hlc_w_per_k_per_m2, CASE WHEN corrected THEN be.hlc * eff END AS space_heating_hlc_w_per_k, CASE WHEN corrected THEN r2 END AS space_heating_r_squared,
    s.hlc * eff AS recent_hlc_w_per_k, s.w AS recent_window_days, s.n AS recent_days_used, (s.hlc * eff - be.hlc * eff) / (be.hlc * eff) * 100 AS recent_change_pct
  FROM be JOIN cf USING (home) LEFT JOIN sh USING (home) LEFT JOIN model_l USING (home) LEFT JOIN md USING (home)),
{GAS_WATER.replace('FROM hh GROUP', "FROM (SELECT hh.* FROM hh JOIN hs USING (home) WHERE " + LOCAL.format('sec').replace('(zone,', '(hh.zone,') + '::DATE >= today - win) GROUP')},
dates AS (SELECT home, max(d) AS latest_complete_gas_day, max(d) FILTER (water IS NOT NULL) AS latest_complete_water_day, max(today) AS today FROM cw GROUP BY 1),
sp AS (SELECT *, greatest(q - hot_kwh, 0.0::DOUBLE) AS space_kwh, today - d - 1 AS age FROM a3_r),
us AS (
  SELECT home, avg(hot_kwh) * 365 AS annual, {recent_sql('hot_kwh', 7, 5)} AS dhw_kwh_per_day_7d, {recent_sql('hot_kwh', 30, 20)} AS dhw_kwh_per_day_30d,
    {recent_sql('space_kwh', 7, 5)} AS space_heating_kwh_per_day_7d, {recent_sql('space_kwh', 30, 20)} AS space_heating_kwh_per_day_30d, count(*) FILTER (off) AS heating_off_days,
    count(*) FILTER (NOT off) AS modelled_days, count(*) FILTER (off AND heat_pct IS NOT NULL) AS heating_off_from_power_days, count(*) FILTER (how = 'litres') AS water_attribution_days,
    count(*) FILTER (how = 'mains') AS baseline_fallback_days, count(*) FILTER (outlier) AS water_outlier_days_ignored
  FROM sp GROUP BY 1),
ww AS (SELECT wn.*, max(d) OVER (PARTITION BY home) - d AS wage FROM wn WHERE water IS NOT NULL),
wl0 AS (SELECT home, water, row_number() OVER (PARTITION BY home ORDER BY water) - 1 AS k, count(*) OVER (PARTITION BY home) AS n FROM ww WHERE wage < 30),
wl AS (SELECT home, CASE WHEN count(*) >= 5 THEN greatest(3 * median(water), 4 * max(water) FILTER (k = 3 * n // 4) - 3 * max(water) FILTER (k = n // 4)) END AS lim FROM wl0 GROUP BY 1),
wu0 AS (
  SELECT home, count(*) AS days_used, {recent_sql('water', 7, 5, 'wage')} AS litres_per_day_7d, count(*) FILTER (wage < 7) AS days_used_7d, {recent_sql('water', 30, 20, 'wage')} AS litres_per_day_30d,
    count(*) FILTER (wage < 30) AS days_used_30d, CASE WHEN count(*) FILTER (wage < 30) >= 20 THEN median(water) FILTER (wage < 30) END AS typical_day_litres_30d,
    count(*) FILTER (wage < 30 AND water > lim) AS high_usage_days_30d, max(lim) AS outlier_limit_litres, max(d) AS latest_complete_day, (max(today) - max(d) - 1)::INT AS source_lag_days
  FROM ww LEFT JOIN wl USING (home) GROUP BY 1),
wu AS (SELECT * FROM wu0 WHERE days_used >= 5 AND litres_per_day_7d IS NOT NULL),
pp AS (SELECT *, max(d) OVER (PARTITION BY home) - d AS page FROM wn WHERE kwh IS NOT NULL),
pu0 AS (
  SELECT home, max(power) AS rate, avg(kwh) FILTER (page < 30) AS kwh_per_day, avg(kwh) AS historical_kwh_per_day, median(least) FILTER (page < 30) AS base, count(*) AS days_used,
    count(*) FILTER (page < 30) AS current_period_days_used, max(d) AS latest_complete_day, {recent_sql('kwh', 7, 5, 'page')} AS last_7d_kwh_per_day, {recent_sql('kwh', 30, 20, 'page')} AS last_30d_kwh_per_day,
    count(*) FILTER (page < 7) AS days_used_7d, CASE WHEN count(*) FILTER (page BETWEEN 30 AND 59) >= 20 THEN avg(kwh) FILTER (page BETWEEN 30 AND 59) END AS previous_30d_kwh_per_day,
    (max(today) - max(d) - 1)::INT AS source_lag_days
  FROM pp GROUP BY 1),
pu AS (SELECT * FROM pu0 WHERE days_used >= 14 AND current_period_days_used >= 14),
{air_sql('hs')},
lv AS (SELECT home, cb.* EXCLUDE (home), hlc_w_per_k AS hlc, eff, ach * area * ceiling * 0.335::DOUBLE AS v FROM cb JOIN hl USING (home) JOIN cf USING (home) WHERE ach * area * ceiling * 0.335::DOUBLE <= hlc_w_per_k),
rm AS (
  SELECT home, string_agg(room || CASE WHEN n = 0 THEN ':none' ELSE ':' || printf('%.3f', tau) || ':' || n || ':' || last || ':' || w END, ',' ORDER BY room) AS rooms
  FROM rooms GROUP BY 1),
every AS (SELECT home FROM cf UNION ALL SELECT 'X')
SELECT every.home, CASE every.home WHEN 'X' THEN 'ceiling_m: not in 1.8..10' END AS config_problem, rm.rooms,
  {', '.join(f'hl.{c} AS hlc_{c}' for c in 'hlc_w_per_k hlc_ci_low_w_per_k hlc_ci_high_w_per_k r_squared days_used residual_autocorrelation effective_independent_days free_gains_kwh_per_day free_gains_w fuel_input_free_gains_kwh_per_day regression_intercept_kwh_per_day fuel_input_hlc_w_per_k fuel_input_r_squared space_heating_fuel_input_hlc_w_per_k delivered_hlc_w_per_k boiler_efficiency_used window_days status model_data_through dhw_baseline_kwh_per_day dhw_baseline_days_used hlc_w_per_k_per_m2 space_heating_hlc_w_per_k space_heating_r_squared recent_hlc_w_per_k recent_window_days recent_days_used recent_change_pct'.split())},
  mr.baseline AS dhw_kwh_per_day, mr.days_used AS dhw_days_used, mr.reference_c AS dhw_outdoor_mean, mr.away_days AS dhw_low_water_days_excluded, CASE WHEN mr.home IS NOT NULL THEN cf.away END AS dhw_min_occupied_water_litres,
  CASE WHEN mr.days_used >= 14 THEN 'valid' WHEN mr.home IS NOT NULL THEN 'provisional' END AS dhw_status, mr.idle AS dhw_idle_gas_kwh_per_day,
  CASE WHEN mr.home IS NOT NULL THEN dates.latest_complete_gas_day END AS dhw_latest_complete_gas_day, CASE WHEN mr.home IS NOT NULL THEN dates.latest_complete_water_day END AS dhw_latest_complete_water_day,
  CASE WHEN mr.home IS NOT NULL THEN (dates.today - dates.latest_complete_water_day - 1)::INT END AS dhw_water_source_lag_days, mr.lim AS dhw_water_outlier_limit_litres,
  us.water_attribution_days AS dhw_water_attribution_days, us.baseline_fallback_days AS dhw_baseline_fallback_days, us.water_outlier_days_ignored AS dhw_water_outlier_days_ignored,
  mr.rate AS dhw_water_rate_wh_per_litre_per_k, mr.rate_days AS dhw_water_rate_days_used, mr.baseline * cf.gas AS dhw_cost_per_day, us.annual * cf.gas AS dhw_cost_per_year,
  CASE WHEN cf.gas IS NOT NULL THEN us.annual END AS dhw_modelled_annual_kwh, CASE WHEN mr.home IS NOT NULL THEN gw.wh END AS dhw_wh_per_litre, CASE WHEN mr.home IS NOT NULL THEN least(100, gw.hot * cf.eff) END AS dhw_hot_fraction_pct,
  {', '.join(f'us.{c} AS usage_{c}' for c in 'dhw_kwh_per_day_7d dhw_kwh_per_day_30d space_heating_kwh_per_day_7d space_heating_kwh_per_day_30d heating_off_days modelled_days heating_off_from_power_days water_attribution_days baseline_fallback_days water_outlier_days_ignored'.split())},
  CASE WHEN us.home IS NOT NULL THEN dates.latest_complete_gas_day END AS usage_latest_complete_gas_day, CASE WHEN us.home IS NOT NULL THEN dates.latest_complete_water_day END AS usage_latest_complete_water_day,
  us.dhw_kwh_per_day_7d * cf.gas AS usage_dhw_cost_per_day_7d, us.space_heating_kwh_per_day_7d * cf.gas AS usage_space_heating_cost_per_day_7d,
  {', '.join(f'wu.{c} AS water_usage_{c}' for c in 'litres_per_day_7d days_used_7d litres_per_day_30d days_used_30d typical_day_litres_30d high_usage_days_30d outlier_limit_litres latest_complete_day days_used source_lag_days'.split())},
  coalesce(cf.has_water, false) AS water_status_configured, CASE WHEN cf.has_water AND wu.home IS NULL THEN coalesce(wu0.days_used, 0) END AS water_status_usable_days, CASE WHEN cf.has_water AND wu.home IS NULL THEN 5 END AS water_status_required_days,
  pu.kwh_per_day AS electricity_kwh_per_day, pu.historical_kwh_per_day AS electricity_historical_kwh_per_day, pu.base * 1000 AS electricity_baseload_w, pu.base * 24 AS electricity_baseload_kwh_per_day,
  pu.kwh_per_day * 1000 / 24 AS electricity_implied_internal_gains_w, pu.days_used AS electricity_days_used, pu.current_period_days_used AS electricity_current_period_days_used,
  pu.latest_complete_day AS electricity_latest_complete_day, CASE WHEN pu.home IS NOT NULL THEN least(100, pu.base * 24 / pu.kwh_per_day * 100) END AS electricity_baseload_share_pct, pu.last_7d_kwh_per_day AS electricity_last_7d_kwh_per_day,
  pu.last_30d_kwh_per_day AS electricity_last_30d_kwh_per_day, pu.days_used_7d AS electricity_days_used_7d, pu.current_period_days_used AS electricity_days_used_30d,
  pu.previous_30d_kwh_per_day AS electricity_previous_30d_kwh_per_day, (pu.last_30d_kwh_per_day - pu.previous_30d_kwh_per_day) / pu.previous_30d_kwh_per_day * 100 AS electricity_change_vs_previous_30d_pct,
  pu.source_lag_days AS electricity_source_lag_days, pu.kwh_per_day * pu.rate AS electricity_cost_per_day, pu.kwh_per_day * pu.rate * 365 AS electricity_cost_per_year,
  pu.last_30d_kwh_per_day * pu.rate AS electricity_cost_per_day_30d, pu.last_30d_kwh_per_day * pu.rate * 365 AS electricity_cost_per_year_30d, pu.base * 24 * pu.rate * 365 AS electricity_baseload_cost_per_year,
  cf.home IS NOT NULL AS electricity_status_configured, CASE WHEN cf.home IS NOT NULL AND pu.home IS NULL THEN coalesce(pu0.days_used, 0) END AS electricity_status_usable_days,
  CASE WHEN cf.home IS NOT NULL AND pu.home IS NULL THEN 14 END AS electricity_status_required_days,
  lv.ach AS losses_ach, lv.windows AS losses_windows, lv.baseline AS losses_baseline_ppm, lv.sensors::BIGINT AS losses_co2_sensors_used, lv.src AS losses_co2_baseline_source, lv.v AS losses_ventilation_w_per_k,
  lv.hlc - lv.v AS losses_fabric_w_per_k, lv.hlc AS losses_hlc_delivered_w_per_k, lv.v / lv.hlc * 100 AS losses_ventilation_share_pct, lv.eff AS losses_boiler_efficiency_used,
  'median of ' || lv.sensors || ' sensors, for the home''s whole volume' AS losses_scope,
  loft.ratio AS loft_ratio, CASE WHEN loft.ratio > 0.5 THEN 'loft follows the house' WHEN loft.ratio > 0.25 THEN 'between house and outdoors' WHEN loft.ratio IS NOT NULL THEN 'loft follows outdoors' END AS loft_verdict,
  loft.n AS loft_hours_used, loft.win AS loft_window_days, loft.iqr AS loft_iqr, loft.outside AS loft_out_of_range_pct, loft.humidity AS loft_humidity_pct
FROM every LEFT JOIN cf ON cf.home = every.home LEFT JOIN rm ON rm.home = every.home LEFT JOIN hl ON hl.home = every.home LEFT JOIN model_r mr ON mr.home = every.home
  LEFT JOIN us ON us.home = every.home LEFT JOIN dates ON dates.home = every.home LEFT JOIN gw ON gw.home = every.home LEFT JOIN wu ON wu.home = every.home LEFT JOIN wu0 ON wu0.home = every.home
  LEFT JOIN pu ON pu.home = every.home LEFT JOIN pu0 ON pu0.home = every.home LEFT JOIN lv ON lv.home = every.home LEFT JOIN loft ON loft.home = every.home"""
)


@query(HOME_REPORT)
def report_homes(spark, sf_dir):
    return flat(home_report(spark, sf_dir))


@query(
    """WITH v AS (SELECT l_returnflag AS home, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT home, max(n) AS n, max(v) FILTER (k = floor(0.02 * (n - 1))) AS p02, max(v) FILTER (k = n // 4) AS q1, max(v) FILTER (k = 3 * n // 4) AS q3,
  round(quantile_cont(v, 0.25), 8) AS line_q1, round(quantile_cont(v, 0.9), 8) AS line_p90 FROM v GROUP BY 1"""
)
def rank_select(spark, sf_dir):
    prices = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("home"), "l_extendedprice")
    exact = ranks.at_ranks(prices, HOME, "l_extendedprice", {"p02": ranks.floor_rank(0.02), "q1": ranks.part_rank(1, 4), "q3": ranks.part_rank(3, 4)})
    lines = ranks.interpolated(prices, HOME, "l_extendedprice", {"line_q1": 0.25, "line_p90": 0.9})
    return exact.join(lines.drop("n"), "home").withColumns({"line_q1": F.round("line_q1", 8), "line_p90": F.round("line_p90", 8)})
