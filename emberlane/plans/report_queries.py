"""Registered queries of the report, cache policy and offline fits, with their SQL.

The report's homes are those of ``house_days``; the last day of each isn't over,
some days have no water reading, and one home has too little electricity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import air, alignment, cooling, daily, hotwater, meters, offline, quality
from ..sources.scratch import written
from ..thresholds import Cooling, Loft
from . import report
from .adapter import C, DAY, H, HOURS, HOUSE, LOCAL, OFF, OUTDOOR, ROOMS, WATER, hourly, house_days, house_hours, means, series_of
from .adapter import meters as meter_rows
from .adapter import table
from .queries import FIT_CTES, FIT_REASON, HOME, MAINS, METER, ORACLES, _off_days, query, r

GAS_RATE, POWER_RATE, EFFICIENCY, AREA, CEILING = 0.07, 0.27, 0.88, 100.0, 2.4
WINDOWS = [60, 120, 365]
S = ["series_id"]


def report_days(spark, sf_dir: str) -> DataFrame:
    """The complete days of all homes, stored: each report reads them several times."""
    days = _off_days(spark, sf_dir)
    number = F.dayofyear("d")
    powered = (number % 17 != 0) & ((F.col("home") != "R") | (number % 50 == 0))
    days = days.withColumns({"water": F.when(number % 13 != 0, F.col("water")), "kwh": F.when(powered, F.col("kwh"))})
    return written(report.complete_days(days, HOME))


REPORT_DAYS = (
    OFF
    + """,
rd AS (
  SELECT home, d, outdoor, delta_t, heat_pct, q, off, least,
    CASE WHEN dayofyear(d) % 13 <> 0 THEN water END AS water,
    CASE WHEN dayofyear(d) % 17 <> 0 AND (home <> 'R' OR dayofyear(d) % 50 = 0) THEN kwh END AS kwh,
    max(d) OVER (PARTITION BY home) AS today
  FROM ho),
rw AS (SELECT * FROM rd WHERE d < today),
homes AS (SELECT home, max(today) AS today, max(d) AS latest_gas_day, max(d) FILTER (water IS NOT NULL) AS latest_water_day FROM rw GROUP BY 1)"""
)
NEAR = ",\nnr AS (SELECT * FROM rw WHERE today - d <= 365)"
#: The same for the days up to the last heated one.
LOCKED = """,
md AS (
  SELECT home, max(d) AS model_day FROM rw
  WHERE today - d <= 365 AND delta_t > 4 AND q > 0.5 AND (heat_pct IS NULL OR heat_pct > 1)
  GROUP BY 1),
lk AS (SELECT rw.*, model_day FROM rw LEFT JOIN md USING (home) WHERE model_day IS NULL OR d <= model_day),
nr AS (SELECT * FROM lk WHERE coalesce(model_day, today) - d <= 365)"""


def water_sql(every: str, near: str = "nr", s: str = "", away: str = "50") -> str:
    """The hot-water model (model and suffix ``s``) of the days of ``near``, with the limit of litres from ``every``."""
    return f""",
bl{s} AS (
  SELECT home,
    median(q) FILTER (coalesce(water >= {away}, true)) AS baseline,
    avg(outdoor) FILTER (coalesce(water >= {away}, true)) AS reference_c,
    count(*) FILTER (coalesce(water >= {away}, true)) AS days_used,
    count(*) FILTER (water < {away}) AS away_days,
    CASE WHEN count(*) FILTER (water < {away}) >= 3 THEN median(q) FILTER (water < {away}) END AS idle
  FROM {near} WHERE off GROUP BY 1
  HAVING count(*) FILTER (coalesce(water >= {away}, true)) >= 7),
lr{s} AS (
  SELECT home, water, row_number() OVER (PARTITION BY home ORDER BY water) - 1 AS k, count(*) OVER (PARTITION BY home) AS n
  FROM (SELECT home, d, water, max(d) OVER (PARTITION BY home) AS last FROM {every} WHERE water IS NOT NULL)
  WHERE last - d < 30),
lq{s} AS (SELECT home, count(*) AS n, median(water) AS m, max(water) FILTER (k = n // 4) AS q1, max(water) FILTER (k = 3 * n // 4) AS q3
  FROM lr{s}
  GROUP BY 1),
li{s} AS (SELECT home, CASE WHEN n >= 5 THEN greatest(3 * m, q3 + 3 * (q3 - q1)) END AS lim FROM lq{s}),
rr{s} AS (
  SELECT home, q * 1000 / water / (55 - {MAINS.format('outdoor')}) AS r
  FROM {near} LEFT JOIN li{s} USING (home)
  WHERE off AND q > 0 AND water >= {away} AND water <= coalesce(lim, water)),
ra{s} AS (SELECT home, median(r) AS rate, count(*) AS rate_days FROM rr{s} GROUP BY 1 HAVING count(*) >= 10 AND median(r) BETWEEN 0.05 AND 1.5),
model{s} AS (SELECT * FROM bl{s} LEFT JOIN ra{s} USING (home) LEFT JOIN li{s} USING (home))"""


def split_sql(rows: str, s: str = "") -> str:
    """Attribution (a3 and suffix) of the days of ``rows`` by the model."""
    return f""",
a1{s} AS (
  SELECT x.*, baseline, reference_c, rate, coalesce(water > lim, false) AS big,
    least(q, water * rate * (55 - {MAINS.format('outdoor')}) / 1000) AS bw,
    least(q, baseline * (55 - {MAINS.format('outdoor')}) / (55 - {MAINS.format('reference_c')})) AS bm
  FROM {rows} x JOIN model{s} USING (home)),
a2{s} AS (
  SELECT *,
    CASE WHEN off THEN 'off' WHEN rate IS NOT NULL AND water IS NOT NULL AND NOT big THEN 'litres' ELSE 'mains' END AS how,
    NOT off AND big AS outlier
  FROM a1{s}),
a3{s} AS (SELECT *, CASE how WHEN 'off' THEN q WHEN 'litres' THEN bw ELSE bm END AS hot_kwh FROM a2{s})"""


#: What gas goes with a litre in each home of the hours of ``hh``; hot is in percent before the boiler's losses.
GAS_WATER = """gw AS (
  SELECT home, regr_slope(gas, litres) * 1000 AS wh, regr_slope(gas, litres) * 1000 / 34.8 * 100 AS hot
  FROM hh GROUP BY 1 HAVING count(*) >= 200 AND count(DISTINCT litres) >= 10 AND regr_slope(gas, litres) > 0 AND regr_r2(gas, litres) >= 0.5)"""


def gas_by_litres(hours: DataFrame, efficiency=EFFICIENCY) -> DataFrame:
    of = lambda name: series_of(hours, name).select("home", "sec", F.col("value").alias("step"))
    return hotwater.gas_water(of("gas"), of("litres"), HOME, efficiency=efficiency)


@query(
    f"""WITH {REPORT_DAYS}{NEAR}{water_sql("rw")}{split_sql("rw")},
ct AS (
  SELECT home, count(*) FILTER (how = 'litres') AS water_days, count(*) FILTER (how = 'mains') AS fallback_days,
    count(*) FILTER (outlier) AS outlier_days, avg(hot_kwh) * 365 AS annual
  FROM a3 GROUP BY 1),
of7 AS (SELECT home, count(*) FILTER (off AND coalesce(water >= 50, true)) AS n FROM nr GROUP BY 1),
{HOURS}, {GAS_WATER}
SELECT home, round(baseline, 2) AS kwh_per_day, CASE WHEN days_used >= 14 THEN 'valid' WHEN days_used >= 7 THEN 'provisional' END AS status,
  days_used, away_days AS low_water_days_excluded, CASE WHEN baseline IS NOT NULL THEN 50.0::DOUBLE END AS min_occupied_water_litres,
  round(idle, 2) AS idle_gas, round(rate, 3) AS water_rate, rate_days AS water_rate_days_used,
  water_days, fallback_days, outlier_days, round(lim, 0) AS outlier_limit, latest_gas_day, latest_water_day,
  (today - latest_water_day - 1)::INT AS water_lag_days, round(baseline * {GAS_RATE}, 2) AS cost_per_day,
  round(annual * {GAS_RATE}, 0) AS cost_per_year, round(annual, 1) AS annual_kwh,
  CASE WHEN baseline IS NOT NULL THEN round(wh, 1) END AS wh_per_litre,
  CASE WHEN baseline IS NOT NULL THEN round(least(100, hot * {EFFICIENCY}), 0) END AS hot_fraction_pct,
  CASE WHEN baseline IS NULL THEN of7.n || ' of 7 days without heating' END AS unavailable_reason
FROM homes LEFT JOIN model USING (home) LEFT JOIN ct USING (home) LEFT JOIN gw USING (home) LEFT JOIN of7 USING (home)"""
)
def report_hot_water(spark, sf_dir):
    litres = gas_by_litres(written(house_hours(spark, sf_dir)))
    return report.hot_water(report_days(spark, sf_dir), HOME, WINDOWS[-1], GAS_RATE, gas_water=litres)


def recent_sql(value: str, days: int, least: int, age: str = "age") -> str:
    near = f"FILTER ({age} BETWEEN 0 AND {days - 1} AND {value} IS NOT NULL)"
    return f"CASE WHEN count(*) {near} >= {least} THEN avg({value}) {near} END"


@query(
    f"""WITH {REPORT_DAYS}{NEAR}{water_sql("rw")}{split_sql("rw")},
s AS (SELECT *, greatest(q - hot_kwh, 0.0::DOUBLE) AS space_kwh, today - d - 1 AS age FROM a3),
u AS (
  SELECT home, {recent_sql('hot_kwh', 7, 5)} AS h7, {recent_sql('hot_kwh', 30, 20)} AS h30,
    {recent_sql('space_kwh', 7, 5)} AS s7, {recent_sql('space_kwh', 30, 20)} AS s30,
    count(*) FILTER (off) AS heating_off_days, count(*) FILTER (NOT off) AS modelled_days,
    count(*) FILTER (off AND heat_pct IS NOT NULL) AS from_power_days, count(*) FILTER (how = 'litres') AS water_days,
    count(*) FILTER (how = 'mains') AS fallback_days, count(*) FILTER (outlier) AS outlier_days
  FROM s GROUP BY 1)
SELECT home, round(h7, 2) AS hot_7d, round(h30, 2) AS hot_30d, round(s7, 2) AS space_7d, round(s30, 2) AS space_30d,
  round(h7 * {GAS_RATE}, 2) AS hot_cost_7d, round(s7 * {GAS_RATE}, 2) AS space_cost_7d, heating_off_days, modelled_days, from_power_days,
  water_days, fallback_days, outlier_days, latest_gas_day, latest_water_day,
  CASE WHEN u.home IS NULL THEN 'needs a gas meter and a hot-water baseline' END AS unavailable_reason
FROM homes LEFT JOIN u USING (home)"""
)
def report_gas_use(spark, sf_dir):
    return report.gas_use(report_days(spark, sf_dir), HOME, WINDOWS[-1], GAS_RATE)


@query(
    f"""WITH {REPORT_DAYS},
e AS (SELECT *, max(d) OVER (PARTITION BY home) - d AS age FROM rw WHERE today - d <= 365 AND kwh IS NOT NULL),
g AS (
  SELECT home, count(*) AS days, count(*) FILTER (age < 30) AS days_30d, count(*) FILTER (age < 7) AS days_7d,
    avg(kwh) FILTER (age < 30) AS mean, avg(kwh) AS historical, median(least) FILTER (age < 30) AS base,
    {recent_sql('kwh', 7, 5)} AS l7, {recent_sql('kwh', 30, 20)} AS l30,
    CASE WHEN count(*) FILTER (age BETWEEN 30 AND 59) >= 20 THEN avg(kwh) FILTER (age BETWEEN 30 AND 59) END AS p30, max(d) AS latest
  FROM e GROUP BY 1),
v AS (SELECT * FROM g WHERE days >= 14 AND days_30d >= 14)
SELECT home, round(v.base * 1000, 0) AS baseload_w, round(v.mean, 2) AS kwh_per_day, round(v.historical, 2) AS historical, round(v.l7, 2) AS last_7d,
  round(v.l30, 2) AS last_30d, round(v.p30, 2) AS previous_30d, round((v.l30 - v.p30) / v.p30 * 100, 1) AS change_pct,
  round(v.base * 24, 2) AS baseload_kwh, CASE WHEN v.mean > 0 THEN round(least(100, v.base * 24 / v.mean * 100), 1) END AS share_pct,
    round(v.mean * 1000 / 24, 0) AS implied_gains_w,
  round(v.mean * {POWER_RATE}, 2) AS cost_day, round(v.mean * {POWER_RATE} * 365, 0) AS cost_year,
  round(v.base * 24 * {POWER_RATE} * 365, 0) AS baseload_cost_year, v.days_7d, v.days_30d, v.latest AS latest_day,
  (today - v.latest - 1)::INT AS lag_days,
  CASE WHEN v.home IS NULL THEN coalesce(g.days, 0) END AS usable_days, CASE WHEN v.home IS NULL THEN 14 END AS required_days,
  CASE WHEN v.home IS NULL AND coalesce(g.days, 0) < 14 THEN coalesce(g.days,
    0) || ' of 14 days' WHEN v.home IS NULL THEN 'too few recent days' END AS unavailable_reason
FROM homes LEFT JOIN g USING (home) LEFT JOIN v USING (home)"""
)
def report_electricity(spark, sf_dir):
    return report.electricity_use(report_days(spark, sf_dir), HOME, WINDOWS[-1], POWER_RATE)


@query(
    f"""WITH {REPORT_DAYS}{NEAR}{water_sql("nr")},
e AS (SELECT nr.*, lim, max(d) OVER (PARTITION BY home) - d AS age FROM nr LEFT JOIN li USING (home) WHERE water IS NOT NULL),
g AS (
  SELECT home, count(*) AS days, {recent_sql('water', 7, 5)} AS l7, {recent_sql('water', 30, 20)} AS l30,
    CASE WHEN count(*) FILTER (age < 30) >= 20 THEN median(water) FILTER (age < 30) END AS typical,
    count(*) FILTER (age < 30 AND water > lim) AS high_days, max(lim) AS lim, count(*) FILTER (age < 7) AS days_7d,
    count(*) FILTER (age < 30) AS days_30d, max(d) AS latest
  FROM e GROUP BY 1),
v AS (SELECT * FROM g WHERE days >= 5 AND l7 IS NOT NULL)
SELECT home, round(v.l7, 1) AS litres_7d, round(v.l30, 1) AS litres_30d, round(v.typical, 1) AS typical_30d, v.high_days AS high_usage_days,
  round(v.lim, 0) AS threshold, v.latest AS latest_day, (today - v.latest - 1)::INT AS lag_days, v.days_7d, v.days_30d,
  CASE WHEN v.home IS NULL THEN coalesce(g.days, 0) END AS usable_days, CASE WHEN v.home IS NULL THEN 5 END AS required_days,
  CASE WHEN v.home IS NULL AND coalesce(g.days, 0) < 5 THEN coalesce(g.days,
    0) || ' of 5 days' WHEN v.home IS NULL THEN 'too few recent days' END AS unavailable_reason
FROM homes LEFT JOIN g USING (home) LEFT JOIN v USING (home)"""
)
def report_water(spark, sf_dir):
    return report.water_use(report_days(spark, sf_dir), HOME, WINDOWS[-1])


_POINTS = """
  SELECT home || '|{kind}' AS home, d, delta_t AS x, q - {hot} AS y
  FROM ax WHERE q > 0.5 AND delta_t > 4 AND q - {hot} > 0{where}"""
HEAT_LOSS = (
    f"WITH {REPORT_DAYS}{LOCKED}{water_sql('lk')}{split_sql('nr')},"
    + "\nax AS (SELECT nr.*, coalesce(hot_kwh, 0) AS hot FROM nr LEFT JOIN (SELECT home, d, hot_kwh FROM a3) USING (home, d)),\np AS ("
    + "\n  UNION ALL".join(
        [_POINTS.format(kind="raw", hot="0", where=""), _POINTS.format(kind="net", hot="hot", where="")]
        + [_POINTS.format(kind=w, hot="hot", where=f" AND model_day - d <= {w}") for w in WINDOWS[:-1]]
    )
    + ")"
    + FIT_CTES
    + f""",
ft AS (SELECT split_part(home, '|', 1) AS home, split_part(home, '|', 2) AS fit, k.* EXCLUDE (home), {FIT_REASON} AS why FROM k),
raw AS (SELECT * FROM ft WHERE fit = 'raw'),
net AS (SELECT ft.* FROM ft JOIN model USING (home) WHERE fit = 'net' AND why IS NULL),
sh AS (SELECT home, min({{'w': fit::INT, 'hlc': hlc, 'n': n}}) AS s FROM ft WHERE fit NOT IN ('raw', 'net') AND why IS NULL GROUP BY 1),
bt AS (
  SELECT home, raw.hlc AS raw_hlc, net.home IS NOT NULL AS corrected,
    UNNEST(CASE WHEN net.home IS NOT NULL THEN {{'hlc': net.hlc, 'slope': net.slope, 'se': net.se, 'r2': net.r2, 'n': net.n, 'r1': net.r1,
      'vif': net.vif, 'intercept': net.intercept}}
      ELSE {{'hlc': raw.hlc, 'slope': raw.slope, 'se': raw.se, 'r2': raw.r2, 'n': raw.n, 'r1': raw.r1, 'vif': raw.vif, 'intercept': raw.intercept}} END)
  FROM raw LEFT JOIN net USING (home) WHERE raw.why IS NULL),
hl AS (
  SELECT homes.home, round(bt.hlc * {EFFICIENCY}, 1) AS hlc_w_per_k,
    CASE WHEN bt.home IS NULL THEN 'invalid' WHEN bt.n >= 30 THEN 'valid' ELSE 'provisional' END AS status,
    round(bt.r2, 3) AS r_squared, bt.n AS days_used, CASE WHEN bt.home IS NOT NULL THEN 365 END AS window_days,
    round((bt.slope - 1.96 * bt.se) * 1000 / 24 * {EFFICIENCY}, 1) AS ci_low, round((bt.slope + 1.96 * bt.se) * 1000 / 24 * {EFFICIENCY}, 1) AS ci_high,
    round(bt.r1, 2) AS residual_autocorrelation, round(bt.n / bt.vif, 0) AS effective_independent_days,
    round(-bt.intercept * 1000 / 24 * {EFFICIENCY}, 0) AS free_gains_w, round(raw_hlc, 1) AS fuel_input_hlc, round(bt.hlc, 1) AS space_heating_fuel_input_hlc,
    CASE WHEN bt.home IS NOT NULL THEN {EFFICIENCY}::DOUBLE END AS boiler_efficiency_used, round(bt.intercept, 1) AS regression_intercept,
    round(bt.hlc * {EFFICIENCY} / {AREA}, 2) AS hlc_per_m2, CASE WHEN bt.home IS NOT NULL THEN round(baseline, 1) END AS dhw_baseline,
    CASE WHEN bt.home IS NOT NULL THEN model.days_used END AS dhw_baseline_days_used,
      CASE WHEN bt.home IS NOT NULL THEN model_day END AS model_data_through,
    CASE WHEN bt.home IS NOT NULL THEN round(s.hlc * {EFFICIENCY}, 1) END AS recent_hlc,
      CASE WHEN bt.home IS NOT NULL THEN s.w END AS recent_window_days,
    CASE WHEN bt.home IS NOT NULL THEN s.n END AS recent_days_used, CASE WHEN corrected THEN round(bt.hlc * {EFFICIENCY}, 1) END AS space_heating_hlc,
    CASE WHEN bt.hlc * {EFFICIENCY} < 100 THEN 'excellent' WHEN bt.hlc * {EFFICIENCY} < 180 THEN 'good' WHEN bt.hlc * {EFFICIENCY} < 280 THEN 'fair'
      WHEN bt.hlc * {EFFICIENCY} < 400 THEN 'poor' WHEN bt.hlc IS NOT NULL THEN 'beyond' END AS band,
    CASE WHEN bt.home IS NULL THEN coalesce(raw_all.why, 'no usable days') END AS unavailable_reason
  FROM homes LEFT JOIN bt ON bt.home = homes.home LEFT JOIN sh ON sh.home = homes.home LEFT JOIN model ON model.home = homes.home LEFT JOIN md ON md.home = homes.home
    LEFT JOIN raw raw_all ON raw_all.home = homes.home)"""
)


@query(f"{HEAT_LOSS}\nSELECT * FROM hl")
def report_heat_loss(spark, sf_dir):
    return report.heat_loss(report_days(spark, sf_dir), HOME, EFFICIENCY, AREA, WINDOWS)


@query(f"{HEAT_LOSS}\nSELECT home, round((recent_hlc - hlc_w_per_k) / hlc_w_per_k * 100, 1) AS recent_change_pct FROM hl")
def report_recency(spark, sf_dir):
    return report.recency(report.heat_loss(report_days(spark, sf_dir), HOME, EFFICIENCY, AREA, WINDOWS), HOME)


def air_changes(hours: DataFrame, homes: DataFrame) -> DataFrame:
    """(home, ach, windows, baseline, sensors, baseline_source) of homes (home, today,
    window_days, outdoor_ppm), from the window's first day on."""
    begun = homes.select("home", F.date_sub("today", F.col("window_days")).alias("since"), "outdoor_ppm")
    rows = series_of(hours, "co2").join(begun, "home").where(meters.local_time(F.col("sec"), F.col("zone")).cast("date") >= F.col("since")).drop("zone", "since")
    sensor = ["home", "series_id"]
    base = air.baseline_ppm(rows, sensor, configured="outdoor_ppm")
    rates = air.air_change_rate(air.decay_fits(rows, base, sensor), sensor).where("usable").join(base, sensor)
    return air.combine(rates, HOME).join(rates.groupBy("home").agg(F.max("baseline_source").alias("baseline_source")), "home")


def air_sql(homes: str) -> str:
    """Combined air changes (cb) of the hours of ``hh``, by ``homes`` (home, today, win, ppm)."""
    return f"""
 cn AS (
  SELECT home, sec, co2 AS v, CASE WHEN sec - lag(sec) OVER w <= 5400 AND co2 <= lag(co2) OVER w + 2 THEN 0 ELSE 1 END AS b
  FROM hh JOIN {homes} c USING (home) WHERE {LOCAL.format('sec').replace('(zone,', '(hh.zone,')}::DATE >= c.today - c.win WINDOW w AS (PARTITION BY home ORDER BY sec)),
 cr AS (SELECT *, sum(b) OVER (PARTITION BY home ORDER BY sec) AS run FROM cn),
 c0 AS (SELECT home, v, row_number() OVER (PARTITION BY home ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY home) AS n FROM cr),
 cs AS (SELECT home, coalesce(ppm, v) AS baseline, CASE WHEN ppm IS NULL THEN 'percentile' ELSE 'configured' END AS src FROM c0 JOIN {homes} USING (home) WHERE k = floor(0.02 * (n - 1))),
 cx AS (SELECT cr.*, v - baseline AS ex, (sec - min(sec) OVER (PARTITION BY cr.home, run)) / 3600.0::DOUBLE AS hours FROM cr JOIN cs USING (home)),
 cz AS (SELECT *, CASE WHEN ex > 0 THEN ln(ex) END AS le FROM cx),
 cf1 AS (
  SELECT home, run, max(sec) - min(sec) AS seconds, min_by(ex, sec) AS first_ex, min(ex) AS least_ex, CASE WHEN count(le) > 1 THEN regr_slope(le, hours) END AS slope,
    CASE WHEN count(le) > 1 THEN regr_r2(le, hours) END AS r2 FROM cz GROUP BY 1, 2),
 ca AS (
  SELECT home, median(-slope) AS ach, count(*) AS windows FROM cf1
  WHERE seconds >= 14400 AND first_ex >= 120 AND least_ex > 0 AND slope < 0 AND r2 >= 0.9 GROUP BY 1 HAVING count(*) >= 10 AND median(-slope) BETWEEN 0.05 AND 3),
 cb AS (SELECT home, ach, windows, baseline, 1 AS sensors, src FROM ca JOIN cs USING (home))"""


LOSSES = (
    HEAT_LOSS
    + f""", hc AS (SELECT home, today, 365 AS win, NULL::DOUBLE AS ppm FROM homes), {HOURS}, {air_sql('hc')},
ls AS (
  SELECT home, hlc_w_per_k, boiler_efficiency_used, cb.* EXCLUDE (home), CASE WHEN ach * {AREA * CEILING} * 0.335::DOUBLE <= hlc_w_per_k THEN ach * {AREA * CEILING} * 0.335::DOUBLE END AS v
  FROM hl LEFT JOIN cb USING (home))
SELECT home, round(ach, 3) AS ach, windows, round(baseline, 0) AS baseline_ppm, sensors::BIGINT AS sensors_used, src AS baseline_source,
  'median of ' || sensors || ' sensors, for the home''s whole volume' AS scope, round(v, 1) AS ventilation_w_per_k, round(hlc_w_per_k - v, 1) AS fabric_w_per_k,
  round(v / hlc_w_per_k * 100, 1) AS share_pct, hlc_w_per_k AS hlc_delivered, boiler_efficiency_used,
  CASE WHEN ach < 0.35 THEN 'tight' WHEN ach < 0.7 THEN 'usual' WHEN ach < 1.0 THEN 'leaky' WHEN ach IS NOT NULL THEN 'beyond' END AS ach_band,
  CASE WHEN v < 120 THEN 'low' WHEN v < 200 THEN 'usual' WHEN v < 300 THEN 'high' WHEN v IS NOT NULL THEN 'beyond' END AS ventilation_band,
  CASE WHEN v IS NULL THEN 'no split available' WHEN hlc_w_per_k - v > 2 * v THEN 'fabric first' ELSE 'ventilation matters' END AS decision
FROM ls"""
)


def _todays(days: DataFrame) -> DataFrame:
    return days.groupBy("home").agg(F.max("today").alias("today"))


@query(LOSSES)
def report_losses(spark, sf_dir):
    days = report_days(spark, sf_dir)
    loss = report.heat_loss(days, HOME, EFFICIENCY, AREA, WINDOWS)
    homes = _todays(days).withColumns({"window_days": F.lit(WINDOWS[-1]), "outdoor_ppm": F.lit(None).cast("double")})
    return report.losses(loss, air_changes(house_hours(spark, sf_dir), homes), HOME, F.lit(AREA * CEILING))


def _side_by_side() -> str:
    """The five reports' SQL joined by home, their columns with the part's prefix."""
    parts = {"hlc": "report_heat_loss", "dhw": "report_hot_water", "gas": "report_gas_use", "elec": "report_electricity", "water": "report_water"}
    of = lambda k: f"(SELECT COLUMNS('^(?:hlc_)?(\\w+)$') AS '{k}_\\1' FROM ({ORACLES[parts[k]]}))"
    joins = " ".join(f"JOIN {of(k)} {k} ON {k}_home = hlc_home" for k in parts if k != "hlc")
    without = ", ".join(f"{k}_home" for k in parts)
    return f"""SELECT hlc_home AS home, * EXCLUDE ({without}) REPLACE (NULL::DOUBLE AS dhw_wh_per_litre, NULL::DOUBLE AS dhw_hot_fraction_pct) FROM {of('hlc')} hlc {joins}"""


@query(_side_by_side())
def report_composite(spark, sf_dir):
    return report.composite(report_days(spark, sf_dir), HOME, EFFICIENCY, AREA, GAS_RATE, POWER_RATE, WINDOWS)


#: Entities that stand for parts: an id from the name, class and unit by the key.
CLASSES = ["temperature", "energy", "carbon_dioxide", "monetary", "humidity", "gas", ""]
UNITS = ["°C", "kWh", "ppm", "GBP/kWh", "%", "m³", "°F"]


def _entities(spark, sf_dir):
    key = F.col("p_partkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.floor(key / by) % len(values) + 1).cast("int"))
    word = pick(["kitchen", "loft", "garden", "heating", "gas", "attic", "study"], 7)
    domain = F.when(key % 11 == 0, "climate").when(key % 13 == 0, "weather").when(key % 17 == 0, "light").otherwise("sensor")
    name = F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "_"))
    entity = F.concat(domain, F.lit("."), word, F.lit("_"), name, F.lit("_"), key.cast("string"), F.when(key % 3 == 0, "_temperature").when(key % 3 == 1, "_heating").otherwise(""))
    friendly = F.when(key % 5 == 0, F.concat(F.lit("Outside "), F.col("p_brand")))
    return table(spark, sf_dir, "part").select(entity.alias("entity_id"), friendly.alias("friendly_name"), pick(CLASSES, 1).alias("device_class"), pick(UNITS, 3).alias("unit"))


ENTITIES = f"""WITH n AS (
  SELECT p_partkey AS k, p_brand, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g')) AS name,
    ['kitchen', 'loft', 'garden', 'heating', 'gas', 'attic', 'study'][(p_partkey // 7) % 7 + 1] AS word,
    {CLASSES!r}[p_partkey % 7 + 1] AS device_class, {UNITS!r}[(p_partkey // 3) % 7 + 1] AS unit,
    CASE WHEN p_partkey % 11 = 0 THEN 'climate' WHEN p_partkey % 13 = 0 THEN 'weather' WHEN p_partkey % 17 = 0 THEN 'light' ELSE 'sensor' END AS domain
  FROM part),
i AS (
  SELECT *, domain || '.' || word || '_' || name || '_' || k || CASE k % 3 WHEN 0 THEN '_temperature' WHEN 1 THEN '_heating' ELSE '' END AS entity_id,
    CASE WHEN k % 5 = 0 THEN 'Outside ' || p_brand END AS friendly_name
  FROM n),
w AS (SELECT *, lower(coalesce(friendly_name, entity_id)) || '|' || entity_id AS text FROM i),
c AS (
  SELECT *, CASE WHEN domain IN ('climate', 'weather') THEN domain WHEN domain = 'sensor' THEN CASE
    WHEN (device_class = 'temperature' OR unit IN ('°C', '°F')) AND regexp_matches(text, 'loft|attic') THEN 'loft_temperature'
    WHEN (device_class = 'temperature' OR unit IN ('°C', '°F')) AND regexp_matches(text, 'outdoor|outside|external|garden|balcony') THEN 'outdoor_temperature'
    WHEN device_class = 'temperature' OR unit IN ('°C', '°F') THEN 'indoor_temperature'
    WHEN unit = '%' AND regexp_matches(text, 'heating') THEN 'heating_power'
    WHEN device_class IN ('energy', 'gas') OR unit IN ('kWh', 'm³') THEN 'energy'
    WHEN device_class = 'carbon_dioxide' THEN 'co2'
    WHEN device_class = 'monetary' AND regexp_matches(lower(unit), 'kwh') AND regexp_matches(text, 'gas') THEN 'gas_rate' END END AS category
  FROM w)"""


@query(f"{ENTITIES} SELECT entity_id, category FROM c")
def entity_categorise(spark, sf_dir):
    return report.categorised(_entities(spark, sf_dir)).select("entity_id", "category")


@query(
    f"""{ENTITIES},
rm AS (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(entity_id, '^sensor\\.', ''), '_temperature$', ''), '_temp$', ''),
  '_thermometer$', '') AS room, max(entity_id) AS temp_series
  FROM c WHERE category = 'indoor_temperature' GROUP BY 1),
hp AS (SELECT regexp_replace(regexp_replace(entity_id, '^sensor\\.', ''), '_heating$', '') AS room, max(entity_id) AS heat_series
  FROM c
  WHERE category = 'heating_power'
  GROUP BY 1)
SELECT room, temp_series, heat_series FROM rm LEFT JOIN hp USING (room)"""
)
def drafted_rooms(spark, sf_dir):
    return report.drafted_rooms(report.categorised(_entities(spark, sf_dir)))


@query(
    f"""{ENTITIES}
SELECT CASE category WHEN 'energy' THEN 'gas_kwh_entity' WHEN 'gas_rate' THEN 'gas_unit_rate_entity' WHEN 'outdoor_temperature' THEN 'outdoor_entity'
  WHEN 'loft_temperature' THEN 'loft_entity' WHEN 'co2' THEN 'co2_entity' WHEN 'weather' THEN 'weather_entity' END AS role, min(entity_id) AS entity_id
FROM c WHERE category IN ('energy', 'gas_rate', 'outdoor_temperature', 'loft_temperature', 'co2', 'weather') GROUP BY 1"""
)
def drafted_roles(spark, sf_dir):
    return report.drafted_roles(report.categorised(_entities(spark, sf_dir)))


def cache_rows(spark, sf_dir: str) -> DataFrame:
    """(series_id, source, sec, value, kind): each meter as three sources. Long
    history; the later half, off by a constant; every third reading with drift. One
    meter lacks the first source, one has kinds that conflict."""
    rows = meter_rows(spark, sf_dir).join(hourly(spark, sf_dir).groupBy("series_id").agg(F.floor(F.avg("sec") / 3600).alias("half")), "series_id")
    hour = F.floor(F.col("sec") / 3600)
    cumulative = F.lit("cumulative")
    parts = [
        ("lts", (F.col("series_id") != "view"), F.col("value"), cumulative),
        ("rest", hour >= F.col("half"), F.col("value") + 1000, F.when(F.col("series_id") == "click", "measurement").otherwise(cumulative)),
        ("own", hour % 3 == 0, F.col("value") * 1.5, cumulative),
    ]
    out = None
    for name, kept, value, kind in parts:
        part = rows.where(kept).select("series_id", F.lit(name).alias("source"), "sec", value.alias("value"), kind.alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


CACHE = (
    C
    + """,
hf AS (SELECT series_id, floor(avg(sec) / 3600) AS half FROM h GROUP BY 1),
cr AS (
  SELECT series_id, 'lts' AS source, sec, value, 'cumulative' AS kind FROM c WHERE series_id <> 'view'
  UNION ALL SELECT c.series_id, 'rest', sec, value + 1000, CASE WHEN c.series_id = 'click' THEN 'measurement' ELSE 'cumulative' END
    FROM c JOIN hf USING (series_id) WHERE sec // 3600 >= half
  UNION ALL SELECT series_id, 'own', sec, value * 1.5::DOUBLE, 'cumulative' FROM c WHERE (sec // 3600) % 3 = 0),
sp AS (SELECT series_id, source, count(*) AS n, min(sec) AS a, max(sec) AS b, max(kind) AS kind FROM cr GROUP BY 1, 2),
an AS (
  SELECT series_id, source AS anchor
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY source <> 'lts', a - b, -n, source) AS k FROM sp) WHERE k = 1)"""
)


@query(f"WITH {CACHE} SELECT series_id, anchor FROM an")
def cache_anchor(spark, sf_dir):
    return quality.anchors(quality.spans(cache_rows(spark, sf_dir), S), S)


@query(
    f"""WITH {CACHE},
kd AS (SELECT series_id, list_sort(list(DISTINCT kind)) AS kinds FROM sp GROUP BY 1),
bs AS (SELECT series_id, source
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY source <> 'lts', -n, source) AS k
  FROM sp)
  WHERE k = 1)
SELECT series_id, CASE WHEN kinds = ['cumulative'] THEN 'merge cumulative' WHEN list_contains(kinds,
  'cumulative') THEN 'one source' ELSE 'merge measurements' END AS policy,
  array_to_string(kinds, ',') AS kinds, CASE WHEN list_contains(kinds, 'cumulative') AND len(kinds) > 1 THEN source END AS preferred
FROM kd JOIN bs USING (series_id)"""
)
def cache_policy(spark, sf_dir):
    found = quality.load_policy(cache_rows(spark, sf_dir), S)
    return found.withColumn("kinds", F.array_join("kinds", ","))


OFFSETS = (
    CACHE
    + """,
gp AS (SELECT series_id, sec - lag(sec) OVER (PARTITION BY series_id ORDER BY sec) AS gap FROM cr JOIN an USING (series_id) WHERE source = anchor),
tl AS (SELECT series_id, least(greatest(median(gap) / 2, 300), 2700)::BIGINT AS tol FROM gp WHERE gap > 0 GROUP BY 1),
pr AS (
  SELECT o.series_id, o.source, o.value - a.value AS diff, row_number() OVER (PARTITION BY o.series_id, o.source, o.sec ORDER BY abs(o.sec - a.sec),
    a.sec) AS k
  FROM cr o JOIN an ON an.series_id = o.series_id AND o.source <> anchor JOIN cr a ON a.series_id = o.series_id AND a.source = anchor
  JOIN tl ON tl.series_id = o.series_id AND abs(o.sec - a.sec) <= tol),
mo AS (SELECT series_id, source, median(diff) AS off_by, count(*) AS pairs FROM pr WHERE k = 1 GROUP BY 1, 2),
ma AS (SELECT series_id, source, median(abs(diff - off_by)) AS mad FROM pr JOIN mo USING (series_id, source) WHERE k = 1 GROUP BY 1, 2),
dc AS (
  SELECT sp.series_id, sp.source, sp.source = anchor AS anchor, pairs, CASE WHEN sp.source = anchor THEN 0.0::DOUBLE ELSE off_by END AS off_by,
    sp.source = anchor OR coalesce(pairs >= 3 AND mad <= greatest(0.25, least(2.0, 0.001::DOUBLE * abs(off_by))), false) AS used
  FROM sp JOIN an USING (series_id) LEFT JOIN mo USING (series_id, source) LEFT JOIN ma USING (series_id, source))"""
)


@query(f"""WITH {OFFSETS} SELECT series_id, source, anchor, used, CASE WHEN anchor THEN NULL ELSE coalesce(pairs, 0) END AS pairs, round(off_by, 8) AS offset_value
  FROM dc""")
def cache_decisions(spark, sf_dir):
    _, decisions = quality.merge_cumulative(written(cache_rows(spark, sf_dir).drop("kind")), S)
    return decisions.select("series_id", "source", "anchor", "used", "pairs", F.round("offset", 8).alias("offset_value"))


@query(
    f"""WITH {OFFSETS},
mg AS (
  SELECT cr.series_id, sec, value - off_by AS value, row_number() OVER (PARTITION BY cr.series_id, sec ORDER BY anchor, source DESC) AS k
  FROM cr JOIN dc USING (series_id, source) WHERE used)
SELECT series_id, sec, round(value, 8) AS value FROM mg WHERE k = 1"""
)
def cache_merged(spark, sf_dir):
    merged, _ = quality.merge_cumulative(written(cache_rows(spark, sf_dir).drop("kind")), S)
    return merged.select("series_id", "sec", r("value"))


@query(
    f"""WITH {CACHE},
mx AS (SELECT series_id, source, sec, CASE WHEN source = 'own' AND (sec // 3600) % 6 = 0 THEN value + 90000 ELSE value END AS value FROM cr),
st AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id, source ORDER BY sec) AS step FROM mx),
ag AS (SELECT series_id, source, count(*) AS n, count(*) FILTER (step < 0) AS dn, count(*) FILTER (step > 400) AS up,
  median(step) FILTER (step > 400) AS mu, median(-step) FILTER (step < 0) AS md
  FROM st
  GROUP BY 1, 2),
vd AS (SELECT *, coalesce(dn >= 2 AND up >= 2 AND abs(mu - md) <= greatest(400, 0.1 * greatest(mu, md)), false) AS mixed FROM ag)
SELECT series_id, source, CASE WHEN mixed THEN 'refused' ELSE 'rewritten' END AS status, CASE WHEN NOT mixed THEN n END AS rows FROM vd"""
)
def cache_repair(spark, sf_dir):
    rows = cache_rows(spark, sf_dir).drop("kind")
    swings = (F.col("source") == "own") & (F.floor(F.col("sec") / 3600) % 6 == 0)
    rows = rows.withColumns({"value": F.when(swings, F.col("value") + 90_000).otherwise(F.col("value")), "seq": F.lit(1)})
    return quality.repair(rows.unionByName(rows.withColumns({"value": F.lit(-1.0), "seq": F.lit(0)})), S, 400.0)[1]


@query(
    f"""WITH {H},
z AS (SELECT sec, avg(mean) AS pct FROM h WHERE series_id IN ('view', 'click') GROUP BY 1)
SELECT {DAY.format('sec')} AS d, round(avg(pct / 100 * 28.0::DOUBLE) * 24, 8) AS q FROM z GROUP BY 1"""
)
def offline_zone_heat(spark, sf_dir):
    zones = means(spark, sf_dir).where(F.col("series_id").isin(ROOMS))
    return offline.zone_heat_kwh(zones, 28.0, [], "UTC").select("d", r("q"))


OFFLINE_DELTA = f"""WITH {H},
i AS (SELECT sec, avg(mean) AS v FROM h WHERE series_id IN ('view', 'click') GROUP BY 1 HAVING count(DISTINCT series_id) = 2),
j AS (SELECT i.sec, i.v, o.mean AS o, row_number() OVER (ORDER BY i.sec) AS k FROM i LEFT JOIN h o ON o.sec = i.sec AND o.series_id = 'error'),
x AS (
  SELECT *, last_value(CASE WHEN o IS NOT NULL THEN k END IGNORE NULLS) OVER b AS k0, last_value(o IGNORE NULLS) OVER b AS o0,
    first_value(CASE WHEN o IS NOT NULL THEN k END IGNORE NULLS) OVER a AS k1, first_value(o IGNORE NULLS) OVER a AS o1
  FROM j WINDOW b AS (ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY sec ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT sec, v - CASE WHEN o IS NOT NULL THEN o WHEN k - k0 <= 1 THEN o0 + coalesce((o1 - o0) * (k - k0) / (k1 - k0), 0) END AS dt FROM x),
g AS (SELECT sec, dt, sec - lag(sec) OVER (ORDER BY sec) AS gap FROM f WHERE dt IS NOT NULL),
cd AS (SELECT median(gap) AS cad FROM g WHERE gap > 0)
SELECT {DAY.format('sec')} AS d, round(avg(dt), 8) AS delta_t, count(*) AS rows FROM g, cd GROUP BY 1, cad HAVING count(*) >= 24 * 3600 / cad * 0.9"""


@query(OFFLINE_DELTA)
def offline_delta_t(spark, sf_dir):
    return offline.daily_delta_t(means(spark, sf_dir), ROOMS, OUTDOOR, [], "UTC").select("d", r("delta_t"), "rows")


@query(
    f"""WITH {HOUSE},
p AS (SELECT home, d, delta_t AS x, q AS y FROM hd WHERE q > 0.5 AND delta_t > 4){FIT_CTES},
v1 AS (SELECT *, {FIT_REASON} AS why FROM k)
SELECT home, n AS days, CASE WHEN why IS NULL THEN round(hlc, 8) END AS hlc, CASE WHEN why IS NULL THEN round((slope - 1.96 * se) * 1000 / 24,
  8) END AS ci_low, round(r2, 8) AS r2,
  'no result: ' || why AS note
FROM v1"""
)
def offline_fit(spark, sf_dir):
    days = written(house_days(spark, sf_dir))
    fits = offline.fit_joined(days.select("home", "d", "q"), days.select("home", "d", "delta_t"), HOME)
    return fits.select("home", "days", r("hlc"), r("ci_low"), r("r2"), "note")


@query(
    f"""WITH {HOUSE},
b9 AS (SELECT home, median(q) AS baseline, avg(outdoor) AS ref FROM hd WHERE delta_t < 3 GROUP BY 1 HAVING count(*) >= 7),
y9 AS (SELECT home, d, delta_t, q - baseline * (55 - {MAINS.format('outdoor')}) / (55 - {MAINS.format('ref')}) AS y, baseline
  FROM hd
  JOIN b9 USING (home)
  WHERE q > 0.5 AND delta_t > 4),
p AS (SELECT home, d, delta_t AS x, y FROM y9 WHERE y > 0.5){FIT_CTES},
v1 AS (SELECT *, {FIT_REASON} AS why FROM k)
SELECT home, n AS days, round(hlc, 8) AS hlc, round(baseline, 8) AS baseline FROM v1 JOIN b9 USING (home) WHERE why IS NULL"""
)
def offline_corrected_fit(spark, sf_dir):
    return offline.corrected_fit(written(house_days(spark, sf_dir)), HOME).select("home", "days", r("hlc"), r("baseline"))


def _filled_sql(column: str, most: int) -> str:
    return f"CASE WHEN {column} IS NOT NULL THEN {column} WHEN k - {column}k0 <= {most} THEN {column}0 + coalesce(({column}1 - {column}0) * (k - {column}k0) / ({column}k1 - {column}k0), 0) END"


def _ends_sql(column: str) -> str:
    known = f"CASE WHEN {column} IS NOT NULL THEN k END"
    return f"last_value({known} IGNORE NULLS) OVER b AS {column}k0, last_value({column} IGNORE NULLS) OVER b AS {column}0, first_value({known} IGNORE NULLS) OVER a AS {column}k1, first_value({column} IGNORE NULLS) OVER a AS {column}1"


@query(
    f"""WITH {H},
i AS (SELECT sec, avg(mean) AS i FROM h WHERE series_id IN ('view', 'click') GROUP BY 1),
l AS (SELECT sec, mean AS l FROM h WHERE series_id = 'signup'), o AS (SELECT sec, mean AS o FROM h WHERE series_id = 'error'),
j AS (SELECT *, row_number() OVER (ORDER BY sec) AS k FROM i FULL JOIN l USING (sec) FULL JOIN o USING (sec)),
x AS (
  SELECT *, {_ends_sql('i')}, {_ends_sql('l')}, {_ends_sql('o')}
  FROM j WINDOW b AS (ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY sec ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT sec, {_filled_sql('i', 24)} AS i, {_filled_sql('l', 24)} AS l, {_filled_sql('o', 24)} AS o FROM x),
rr AS (SELECT (l - o) / (i - o) AS r FROM f WHERE (sec // 3600) % 24 BETWEEN 1 AND 5 AND i - o > 2)
SELECT round(median(r), 8) AS ratio, count(r) AS rows, round(quantile_cont(r, 0.75) - quantile_cont(r, 0.25), 8) AS iqr,
  round(avg(CASE WHEN r BETWEEN 0 AND 1 THEN 0.0 ELSE 1.0 END) * 100, 8) AS outside_pct
  FROM rr"""
)
def offline_loft_ratio(spark, sf_dir):
    rows = means(spark, sf_dir)
    of = lambda name: rows.where(F.col("series_id") == name).select("sec", "value")
    out = air.loft_ratio_filled(daily.hourly_over_any(rows, ROOMS, []), of(WATER), of(OUTDOOR), [], "UTC", Loft(min_delta_t=2.0))
    return out.select(r("ratio"), "rows", r("iqr"), r("outside_pct"))


@query()
def offline_nights(spark, sf_dir):
    """Nights across midnight on a grid of five minutes, by the full search."""
    rows = means(spark, sf_dir)
    grid = alignment.on_grid(rows.where(F.col("series_id").isin([*ROOMS, OUTDOOR])), S, 300, 24)
    rooms = grid.where(F.col("series_id").isin(ROOMS)).select(F.col("series_id").alias("room"), "sec", "value")
    out = grid.where(F.col("series_id") == OUTDOOR).select("sec", "value")
    return cooling.fit_tau(cooling.long_nights(rooms, out, ["room"], "UTC"), Cooling())


@query(
    f"""WITH {C}, g AS (SELECT series_id, sec, sec - lag(sec) OVER w AS gap, value - lag(value) OVER w AS step FROM c WINDOW w AS (PARTITION BY series_id ORDER BY sec))
SELECT series_id, {DAY.format('sec')} AS d, round(sum(step), 8) AS q FROM g WHERE gap <= 5400 AND step BETWEEN 0 AND 400 GROUP BY 1, 2 HAVING count(*) >= 23 * 0.9"""
)
def offline_meter_heat(spark, sf_dir):
    """Heat of complete days by the meters, as the offline fits take it."""
    return offline.meter_heat_kwh(meter_rows(spark, sf_dir), S, "UTC", METER).select("series_id", "d", r("q"))


@query(
    """WITH o AS (SELECT o_custkey AS series_id, o_orderkey, epoch(o_orderdate)::BIGINT AS day, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS mean FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY o_orderkey DESC) AS k FROM o WHERE mean IS NOT NULL)
SELECT series_id, day AS sec, round(mean, 8) AS value FROM k WHERE k = 1"""
)
def stat_series(spark, sf_dir):
    """Statistics rows as series: stamps in seconds or milliseconds, null means go, the last row of a stamp stays."""
    second = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate")).cast("double")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("series_id"), F.when((F.col("o_orderkey") % 2 == 1) & (second > 1e9), second * 1000).otherwise(second).alias("start"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("mean"), F.col("o_orderkey").alias("seq"),
    )
    return meters.series(rows, "mean", S).select("series_id", "sec", r("value"))


@query(f"WITH {H} SELECT series_id, max(sec) AS sec, round(max_by(mean, sec), 8) AS value FROM h GROUP BY 1")
def latest_value(spark, sf_dir):
    best = means(spark, sf_dir).groupBy("series_id").agg(F.max("sec").alias("sec"), F.max_by("value", "sec").alias("value"))
    return best.select("series_id", "sec", r("value", 8))
