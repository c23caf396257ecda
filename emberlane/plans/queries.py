"""Registered telemetry queries: each over its whole tables, with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import air, alignment, cooling, daily, heatloss, hotwater, meters, quality, usage
from ..sources.scratch import written
from ..thresholds import AirChange, Cooling, HeatLoss, HotWater, Loft, Meter
from . import report
from .adapter import C, DAY, GAS, H, HOURS, HOUSE, LOCAL, OFF, OUTDOOR, ROOMS, STEPS, WATER, hourly, house_days, house_hours, means, series_of
from .adapter import meters as meter_rows
from .adapter import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
S = ["series_id"]
HOME = ["home"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r(name: str, digits: int = 8):
    return F.round(name, digits).alias(name)


def lineitem_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("d"))
    return days.agg(F.sum("l_quantity").alias("delta_t"), (F.sum("l_extendedprice") / 1000).alias("q")).withColumn("home", F.lit("all"))


FIT_CTES = """, l AS (SELECT home, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, count(*) AS n, regr_sxx(y,
  x) AS sxx, max(x) - min(x) AS spread
  FROM p
  GROUP BY home),
 e AS (SELECT p.home, d, y - intercept - slope * x AS e FROM p JOIN l USING (home)),
 m AS (SELECT home, d, e, avg(e) OVER (PARTITION BY home) AS m, lag(e) OVER w AS pe, d - lag(d) OVER w AS gd
  FROM e
  WINDOW w AS (PARTITION BY home ORDER BY d)),
 a AS (SELECT home, count(*) FILTER (gd = 1) AS pairs, avg((e - m) * (pe - m)) FILTER (gd = 1) / var_pop(e) AS r, sum(e * e) AS sse
  FROM m
  GROUP BY home),
 v AS (SELECT *, CASE WHEN pairs < 10 THEN 0 ELSE r END AS r1 FROM a),
 f AS (SELECT *, (1 + least(greatest(r1, 0), 0.9)) / (1 - least(greatest(r1, 0), 0.9)) AS vif FROM v JOIN l USING (home)),
 k AS (SELECT *, slope * 1000 / 24 AS hlc, sqrt(sse / (n - 2) / sxx) * sqrt(vif) AS se FROM f)"""
FIT_REASON = """CASE WHEN n < 20 THEN 'too few days' WHEN spread < 3 THEN 'too little spread' WHEN slope <= 0 THEN 'slope isn''t positive' WHEN r2 < 0.5 THEN 'weak fit'
  WHEN hlc < 10 OR hlc > 1500 THEN 'out of bounds' WHEN slope - 1.96 * se <= 0 THEN 'limits include zero' END"""
FIT_SQL = (
    FIT_CTES
    + f"""
SELECT home, round(slope, 8) AS slope, round(intercept, 8) AS intercept, round(r2, 8) AS r2, n, pairs, round(r1, 8) AS r1, round(hlc, 8) AS hlc,
  round(n / vif, 8) AS effective_days,
 round((slope - 1.96 * se) * 1000 / 24, 8) AS ci_low, round((slope + 1.96 * se) * 1000 / 24, 8) AS ci_high,
 {FIT_REASON} AS rejection_reason FROM k"""
)


def _fit_columns(fit: DataFrame) -> DataFrame:
    return fit.select("home", r("slope"), r("intercept"), r("r2"), "n", "pairs", r("r1"), r("hlc"), r("effective_days"), r("ci_low"), r("ci_high"), "rejection_reason")


@query("WITH p AS (SELECT 'all' AS home, l_shipdate::DATE AS d, sum(l_quantity) AS x, sum(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY 2 HAVING sum(l_quantity) > 4 AND sum(l_extendedprice) / 1000 > 0.5)" + FIT_SQL)
def hlc_fit(spark, sf_dir):
    return _fit_columns(heatloss.fit(heatloss.fit_points(lineitem_days(spark, sf_dir)), HOME))


@query(f"WITH {H} SELECT series_id, sec, round(mean, 8) AS mean, round(inc, 8) AS inc FROM h")
def stats_hourly(spark, sf_dir):
    return hourly(spark, sf_dir).select("series_id", "sec", r("mean", 8), r("inc"))


METER = Meter(max_step=400.0)


@query(f"WITH {STEPS.format(400)} SELECT series_id, sec, round(step, 8) AS step FROM st")
def meter_steps(spark, sf_dir):
    return meters.steps(meter_rows(spark, sf_dir), S, METER).select("series_id", "sec", r("step"))


@query(f"""WITH {STEPS.format(400)} SELECT series_id, {DAY.format('sec')} AS d, round(sum(step), 8) AS total, round(min(step), 8) AS least, count(*) AS hours,
  count(*) >= 23 * 0.9 AS complete
  FROM st
  GROUP BY 1, 2""")
def daily_meter_complete(spark, sf_dir):
    days = meters.daily(meters.steps(meter_rows(spark, sf_dir), S, METER), S, "UTC", METER)
    return days.select("series_id", "d", r("total"), r("least"), "hours", "complete")


@query(
    """WITH x AS (SELECT l_shipdate::DATE AS d, count(*) AS n FROM lineitem GROUP BY 1),
 y AS (SELECT d, n, make_date(year(d), 4, 1) AS a, make_date(year(d), 10, 31) AS o FROM x)
SELECT d, n, CASE WHEN d = a + ((7 - dayofweek(a)) % 7)::INT THEN 23 WHEN d = o - dayofweek(o)::INT THEN 25 ELSE 24 END::BIGINT AS hours FROM y"""
)
def day_hours_dst(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("hours", meters.day_hours(F.col("d"), "America/New_York"))


@query(f"WITH {H} SELECT series_id, {DAY.format('sec')} AS d, round(avg(mean), 8) AS value, count(*) AS hours FROM h GROUP BY 1, 2")
def daily_mean(spark, sf_dir):
    return daily.daily_mean(means(spark, sf_dir), S, "UTC").select("series_id", "d", r("value", 8), "hours")


ALL = "(SELECT sec, avg(mean) AS v, max(mean) AS m FROM h WHERE series_id IN ('view', 'click') GROUP BY sec HAVING count(DISTINCT series_id) = 2)"


@query(f"""WITH {H}, i AS {ALL} SELECT {DAY.format('i.sec')} AS d, round(avg(v - mean), 8) AS delta_t, count(*) AS hours
  FROM i
  JOIN h ON h.sec = i.sec AND series_id = 'error'
  GROUP BY 1
  HAVING count(*) >= 18""")
def daily_delta_all_rooms(spark, sf_dir):
    return daily.daily_delta_t(means(spark, sf_dir), ROOMS, OUTDOOR, [], "UTC").select("d", r("delta_t"), "hours")


@query(f"""WITH {H}, i AS {ALL} SELECT {DAY.format('sec')} AS d, round(avg(m), 8) AS heat_pct, count(*) AS hours
  FROM i
  GROUP BY 1
  HAVING count(*) >= 18""")
def daily_busiest(spark, sf_dir):
    return daily.daily_busiest(means(spark, sf_dir), ROOMS, [], "UTC").select("d", r("heat_pct"), "hours")


def _off_days(spark, sf_dir):
    days = written(house_days(spark, sf_dir))
    off = daily.heating_off(days.select("home", "d", "delta_t"), days.where("heat_pct is not null").select("home", "d", "heat_pct"), HOME)
    return days.join(off, ["home", "d"])


@query(f"WITH {OFF} SELECT home, d, off FROM ho")
def day_classification(spark, sf_dir):
    return _off_days(spark, sf_dir).select("home", "d", "off")


MAINS = "(4 + 12 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({0} - 2) / 16)))"
BASE = (
    OFF
    + """, bl AS (SELECT home, median(q) FILTER (NOT (water < 50)) AS baseline, avg(outdoor) FILTER (NOT (water < 50)) AS reference_c,
      count(*) FILTER (NOT (water < 50)) AS days_used,
   count(*) FILTER (water < 50) AS away_days, median(q) FILTER (water < 50) AS idle FROM ho WHERE off GROUP BY home),
 lr AS (SELECT home, water, row_number() OVER (PARTITION BY home ORDER BY water) - 1 AS k, count(*) OVER (PARTITION BY home) AS n
  FROM (SELECT *, max(d) OVER (PARTITION BY home) AS last
  FROM ho)
  WHERE last - d < 30),
 li AS (SELECT home, greatest(3 * median(water),
   max(water) FILTER (k = 3 * n // 4) + 3 * (max(water) FILTER (k = 3 * n // 4) - max(water) FILTER (k = n // 4))) AS lim
  FROM lr
  GROUP BY home),
 rr AS (SELECT ho.home, q * 1000 / water / (55 - """
    + MAINS.format("outdoor")
    + """) AS r FROM ho JOIN li USING (home) WHERE off AND q > 0 AND water >= 50 AND water <= lim),
 rk AS (SELECT home, r, row_number() OVER (PARTITION BY home ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY home) AS n FROM rr),
 ra AS (SELECT home, median(r) AS rate, count(*) AS rate_days, max(r) FILTER (k = 3 * n // 4) - max(r) FILTER (k = n // 4) AS rate_iqr
  FROM rk
  GROUP BY home)"""
)


def _hot_water(days):
    limits = hotwater.outlier_limit(days, HOME)
    rates = hotwater.water_rate(days.join(limits, HOME), HOME, limit="limit")
    return hotwater.baseline(days, HOME), rates, limits


@query(f"""WITH {BASE} SELECT home, round(baseline, 8) AS baseline, round(reference_c, 8) AS reference_c, days_used, away_days,
  round(CASE WHEN away_days >= 3 THEN idle END, 8) AS idle_kwh,
  CASE WHEN days_used < 7 THEN 'invalid' WHEN days_used >= 14 THEN 'valid' ELSE 'provisional' END AS status
  FROM bl""")
def baseline_away_days(spark, sf_dir):
    return hotwater.baseline(_off_days(spark, sf_dir), HOME).select("home", r("baseline"), r("reference_c"), "days_used", "away_days", r("idle_kwh"), "status")


@query(f"""WITH {BASE} SELECT home, round(rate, 8) AS rate, rate_days, round(rate_iqr, 8) AS rate_iqr, rate_days >= 10 AND rate BETWEEN 0.05 AND 1.5 AS usable
  FROM ra""")
def water_rate(spark, sf_dir):
    return _hot_water(_off_days(spark, sf_dir))[1].select("home", r("rate"), "rate_days", r("rate_iqr"), "usable")


ATTRIBUTED = (
    BASE
    + ", att AS (SELECT ho.*, baseline, reference_c, CASE WHEN rate_days >= 10 AND rate BETWEEN 0.05 AND 1.5 THEN rate END AS rate, lim FROM ho JOIN bl USING (home) JOIN ra USING (home) JOIN li USING (home)),"
    + f" a2 AS (SELECT *, water > lim AS outl, least(q, water * rate * (55 - {MAINS.format('outdoor')}) / 1000) AS bw, least(q, baseline * (55 - {MAINS.format('outdoor')}) / (55 - {MAINS.format('reference_c')})) AS bm FROM att),"
    + " a3 AS (SELECT *, CASE WHEN off THEN q WHEN rate IS NOT NULL AND NOT outl THEN bw ELSE bm END AS hot_kwh, CASE WHEN off THEN 'off' WHEN rate IS NOT NULL AND NOT outl THEN 'litres' ELSE 'mains' END AS how, NOT off AND outl AS outlier FROM a2)"
)


def _attribution(days):
    base, rates, limits = _hot_water(days)
    usable = rates.select("home", F.when(F.col("usable"), F.col("rate")).alias("rate"))
    known = base.select("home", "baseline", "reference_c").join(usable, "home", "left").join(limits, "home", "left")
    return hotwater.attribute(days.join(known, "home"))


def _attributed(spark, sf_dir):
    return written(_attribution(_off_days(spark, sf_dir)))


@query(f"WITH {ATTRIBUTED} SELECT home, d, how, outlier, round(hot_kwh, 8) AS hot_kwh FROM a3")
def attribution(spark, sf_dir):
    return _attributed(spark, sf_dir).select("home", "d", "how", "outlier", r("hot_kwh"))


@query(f"""WITH {ATTRIBUTED} SELECT home, year(d)::BIGINT AS year, count(*) AS days, count(*) FILTER (off) AS off_days, round(avg(hot_kwh), 8) AS hot_kwh,
  round(avg(greatest(q - hot_kwh, 0.0::DOUBLE)), 8) AS space_kwh, round(avg(hot_kwh) * 365 * 0.07, 8) AS cost_year
  FROM a3
  GROUP BY 1, 2""")
def usage_split(spark, sf_dir):
    rows = _attributed(spark, sf_dir).withColumn("space", F.greatest(F.col("q") - F.col("hot_kwh"), F.lit(0.0)))
    out = rows.groupBy("home", F.year("d").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("days"), F.count_if("off").alias("off_days"), F.avg("hot_kwh").alias("hot_kwh"), F.avg("space").alias("space_kwh"), (F.avg("hot_kwh") * 365 * 0.07).alias("cost_year")
    )
    return out.select("home", "year", "days", "off_days", r("hot_kwh"), r("space_kwh"), r("cost_year"))


@query(f"WITH {ATTRIBUTED}, p AS (SELECT home, d, delta_t AS x, q - coalesce(hot_kwh, 0) AS y FROM a3 WHERE q > 0.5 AND delta_t > 4 AND q - coalesce(hot_kwh, 0) > 0)" + FIT_SQL)
def hlc_adjusted(spark, sf_dir):
    return _fit_columns(heatloss.fit(heatloss.fit_points(_attributed(spark, sf_dir), hot_water="hot_kwh"), HOME))


@query(f"""WITH {HOUSE}, p AS (SELECT home, d, delta_t AS x, q AS y FROM hd WHERE q > 0.5 AND delta_t > 4),
l AS (SELECT home, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p GROUP BY 1)
SELECT home, d, round(y - i - s * x, 8) AS residual FROM p JOIN l USING (home)""")
def ols_residuals(spark, sf_dir):
    points = heatloss.fit_points(house_days(spark, sf_dir))
    lines = points.groupBy("home").agg(*stats.ols("y", "delta_t"))
    return points.join(lines.select("home", "slope", "intercept"), "home").select("home", "d", F.round(F.col("y") - F.col("intercept") - F.col("slope") * F.col("delta_t"), 8).alias("residual"))


@query(f"""WITH {HOUSE} SELECT home, d, round({MAINS.format('outdoor')}, 8) AS mains_c,
  round(12 * (55 - {MAINS.format('outdoor')}) / (55 - {MAINS.format('10.0::DOUBLE')}), 8) AS scaled_kwh
  FROM hd""")
def mains_model(spark, sf_dir):
    days = house_days(spark, sf_dir)
    return days.select("home", "d", F.round(hotwater.mains_c(F.col("outdoor")), 8).alias("mains_c"), F.round(hotwater.scaled_kwh(F.lit(12.0), F.col("outdoor"), F.lit(10.0)), 8).alias("scaled_kwh"))


@query(
    f"""WITH {STEPS.format(400)}, j AS (SELECT a.step AS y, b.step AS x
  FROM st a
  JOIN st b ON a.sec = b.sec AND a.series_id = 'purchase' AND b.series_id = 'signup')
SELECT round(regr_slope(y, x) * 1000, 8) AS wh_per_litre, round(regr_r2(y, x), 8) AS r2, count(*) AS n, round(least(100, regr_slope(y,
  x) * 1000 * 0.88::DOUBLE / 34.8 * 100), 8) AS hot_pct, count(*) >= 200 AND regr_slope(y, x) > 0 AND regr_r2(y, x) >= 0.5 AS usable
  FROM j"""
)
def gas_water_regression(spark, sf_dir):
    steps = meters.steps(meter_rows(spark, sf_dir), S, METER)
    of = lambda name: steps.where(F.col("series_id") == name).select("sec", "step")
    return hotwater.gas_water(of(GAS), of(WATER), []).select(r("wh_per_litre"), r("r2"), "n", r("hot_pct"), "usable")


@query(
    f"""WITH {H}, v AS (SELECT sec FROM h WHERE series_id = 'view'),
e AS (SELECT sec FROM h WHERE series_id = 'error')
SELECT (SELECT count(*)
  FROM (SELECT sec
  FROM v INTERSECT SELECT sec
  FROM e)) AS both_hours, (SELECT count(*)
  FROM (SELECT sec
  FROM v
  UNION SELECT sec
  FROM e)) AS any_hours, (SELECT count(*)
  FROM (SELECT sec
  FROM v EXCEPT SELECT sec
  FROM e)) AS view_only, (SELECT count(*)
  FROM h
  WHERE series_id = 'click' AND sec IN (SELECT sec
  FROM e)) AS click_semi"""
)
def hour_sets(spark, sf_dir):
    rows = means(spark, sf_dir)
    of = lambda name: rows.where(F.col("series_id") == name).select("sec")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    v, e = of("view"), of("error")
    out = n(v.intersect(e), "both_hours").crossJoin(n(v.union(e).distinct(), "any_hours"))
    return out.crossJoin(n(v.join(e, "sec", "left_anti"), "view_only")).crossJoin(n(of("click").join(e, "sec", "left_semi"), "click_semi"))


RUNS = (
    H
    + """, n AS (SELECT series_id, sec, mean AS v, CASE WHEN sec - lag(sec) OVER w <= 5400 AND mean <= lag(mean) OVER w + 2 THEN 0 ELSE 1 END AS b
  FROM h
  WINDOW w AS (PARTITION BY series_id ORDER BY sec)),
 rn AS (SELECT *, sum(b) OVER (PARTITION BY series_id ORDER BY sec) AS run FROM n),
 k0 AS (SELECT series_id, v, row_number() OVER (PARTITION BY series_id ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n FROM rn),
 bs AS (SELECT series_id, v AS baseline FROM k0 WHERE k = floor(0.02 * (n - 1))),
 x AS (SELECT rn.*, baseline, v - baseline AS ex, (sec - min(sec) OVER (PARTITION BY rn.series_id, run)) / 3600.0::DOUBLE AS hours
  FROM rn
  JOIN bs USING (series_id)),
 z AS (SELECT *, CASE WHEN ex > 0 THEN ln(ex) END AS le FROM x),
 fr AS (SELECT series_id, run::BIGINT AS run, count(*) AS points, max(sec) - min(sec) AS seconds, min_by(ex, sec) AS first_excess,
   min(ex) AS least_excess,
   CASE WHEN min(hours) FILTER (le IS NOT NULL) = max(hours) FILTER (le IS NOT NULL) THEN 0 ELSE regr_slope(le, hours) END AS slope,
   CASE WHEN min(hours) FILTER (le IS NOT NULL) = max(hours) FILTER (le IS NOT NULL) OR min(le) = max(le) THEN 0 ELSE regr_r2(le, hours) END AS r2
  FROM z
  GROUP BY 1, 2),
 ct AS (SELECT *, coalesce(seconds >= 7200 AND first_excess >= 3 AND least_excess > 0 AND slope < 0 AND r2 >= 0.5, false) AS counts FROM fr)"""
)
FALL = AirChange(min_window_s=7200, min_excess=3.0, min_r2=0.5, min_windows=3)


def _decays(spark, sf_dir):
    rows = means(spark, sf_dir)
    base = air.baseline_ppm(rows, S, FALL)
    return air.decay_fits(rows, base, S, FALL), base


@query(f"""WITH {RUNS} SELECT series_id, run, points, seconds, round(first_excess, 8) AS first_excess, round(slope, 8) AS slope, round(r2, 8) AS r2, counts
  FROM ct""")
def co2_runs(spark, sf_dir):
    return _decays(spark, sf_dir)[0].select("series_id", "run", "points", "seconds", r("first_excess"), r("slope"), r("r2"), F.coalesce("counts", F.lit(False)).alias("counts"))


ACH = RUNS + ", ac AS (SELECT series_id, median(-slope) FILTER (counts) AS ach, count(*) FILTER (counts) AS windows FROM ct GROUP BY 1)"


@query(f"WITH {ACH} SELECT series_id, round(ach, 8) AS ach, windows, coalesce(windows >= 3 AND ach BETWEEN 0.05 AND 3, false) AS usable FROM ac")
def air_change_rate(spark, sf_dir):
    return air.air_change_rate(_decays(spark, sf_dir)[0], S, FALL).select("series_id", r("ach"), "windows", "usable")


@query(f"""WITH {ACH} SELECT round(median(ach), 8) AS ach, sum(windows)::BIGINT AS windows, round(median(baseline), 8) AS baseline, count(*) AS sensors,
  round(median(ach) * 240 * 0.335, 8) AS ventilation_w_per_k, round(300 - median(ach) * 240 * 0.335, 8) AS fabric_w_per_k
  FROM ac
  JOIN bs USING (series_id)""")
def loss_split(spark, sf_dir):
    fits, base = _decays(spark, sf_dir)
    rates = air.air_change_rate(fits, S, FALL).join(base, "series_id")
    out = air.split_losses(air.combine(rates).withColumn("hlc", F.lit(300.0)), "hlc", "ach", F.lit(240.0))
    return out.select(r("ach"), "windows", r("baseline"), "sensors", r("ventilation_w_per_k"), r("fabric_w_per_k"))


COOL = Cooling()
#: Rooms of every home; one has a heating sensor.
HOUSE_ROOMS = [("room_a", "room_a", "heat_a"), ("room_b", "room_b", None)]
ZONED = ["home", "zone"]


def house_rooms(spark):
    return spark.createDataFrame(HOUSE_ROOMS, "room string, temp_series string, heat_series string")


def night_fits(hours):
    """Fits of all nights in ``hours``, local nights of each home's zone."""
    outdoor = series_of(hours, "outdoor").drop("series_id")
    rooms = house_rooms(hours.sparkSession)
    return cooling.fit_tau(cooling.nights(series_of(hours, "room_a", "room_b"), rooms, outdoor, ZONED, F.col("zone"), COOL, heat=series_of(hours, "heat_a")), COOL)


def _night_fits(spark, sf_dir):
    return night_fits(written(house_hours(spark, sf_dir)))


def tau_sql(where: str = "") -> str:
    """Nights of the hours of ``hh``: up to seven hourly points, the search unrolled."""
    steps = "".join(f", o[{i}] / 2 + o[{i + 1}] / 2 AS b{i}, b{i} + (m{i - 1} - b{i}) * f AS m{i}" for i in range(1, 7)).replace("(m0 ", "(t[1] ")
    errors = " + ".join(f"(m{i} - t[{i + 1}]) ** 2" if i < 5 else f"coalesce((m{i} - t[{i + 1}]) ** 2, 0)" for i in range(1, 7))
    return f"""
 q AS (
  SELECT home, zone, unnest([{{'room': 'room_a', 't': room_a, 'heat': heat_a}}, {{'room': 'room_b', 't': room_b, 'heat': NULL}}], recursive := true), outdoor AS o, sec,
    {LOCAL.format('sec')} AS lt FROM hh),
 qn AS (SELECT *, lt::DATE AS d, sec - lag(sec) OVER (PARTITION BY home, room, lt::DATE ORDER BY sec) AS gap FROM q WHERE hour(lt) BETWEEN 0 AND 5),
 nt AS (
  SELECT home, room, d, count(*) AS n_points, list(t ORDER BY sec) AS t, list(o ORDER BY sec) AS o, avg(t) AS mean,
    CASE WHEN count(*) < 5 THEN 'too few points' WHEN max(gap) > 5400 THEN 'gap' WHEN count(o) < count(*) THEN 'no outdoor temperature'
      WHEN room = 'room_a' AND count(heat) < count(*) * 0.8 THEN 'heating unknown' WHEN room = 'room_a' AND max(heat) > 1 THEN 'heated'
      WHEN min(t - o) < 3 THEN 'too warm outside' WHEN min_by(t, sec) - max_by(t, sec) < 0.3 THEN 'no drop' END AS why
  FROM qn{where} GROUP BY 1, 2, 3),
 sm AS (
  SELECT home, room, d, tau, t, {errors} AS sse
  FROM (SELECT home, room, d, t, k * 0.25 AS tau, exp(-1 / (k * 0.25::DOUBLE)) AS f{steps} FROM nt, range(4, 801) r(k) WHERE why IS NULL)),
 bt AS (SELECT home, room, d, min({{'sse': sse, 'tau': tau}}) AS b FROM sm GROUP BY 1, 2, 3),
 tf AS (
  SELECT nt.home, nt.room, nt.d, n_points, b.tau::DOUBLE AS tau_h, b.sse AS sse, 1 - b.sse / list_sum(list_transform(t, lambda x: (x - mean) ** 2)) AS r2,
    coalesce(why, CASE WHEN b.tau >= 200 THEN 'at the end of the grid' WHEN 1 - b.sse / list_sum(list_transform(t, lambda x: (x - mean) ** 2)) < 0.8 THEN 'weak fit' END) AS rejection_reason
  FROM nt LEFT JOIN bt USING (home, room, d))"""


TAU = HOURS + "," + tau_sql()


@query(f"WITH {TAU} SELECT home, room, d, n_points, tau_h, round(sse, 8) AS sse, rejection_reason FROM tf")
def tau_grid_fit(spark, sf_dir):
    return _night_fits(spark, sf_dir).select("home", "room", "d", "n_points", "tau_h", r("sse"), "rejection_reason")


@query(f"""WITH {TAU} SELECT home, room, count(*) FILTER (rejection_reason IS NULL) AS nights_fitted, median(tau_h) FILTER (rejection_reason IS NULL) AS tau_median_h,
  min(tau_h) FILTER (rejection_reason IS NULL) AS tau_min_h, max(tau_h) FILTER (rejection_reason IS NULL) AS tau_max_h,
  max(d) FILTER (rejection_reason IS NULL) AS last_night
  FROM tf
  GROUP BY 1, 2""")
def tau_summary(spark, sf_dir):
    return cooling.summary(_night_fits(spark, sf_dir), HOME)


LOFT = Loft(min_delta_t=2.0)


@query(
    f"""WITH {H}, i AS (SELECT sec, avg(mean) AS i FROM h WHERE series_id IN ('view', 'click') GROUP BY sec),
j AS (SELECT (l.mean - o.mean) / (i - o.mean) AS r
  FROM i
  JOIN h l ON l.sec = i.sec AND l.series_id = 'signup'
  JOIN h o ON o.sec = i.sec AND o.series_id = 'error'
  WHERE (i.sec // 3600) % 24 BETWEEN 1 AND 5 AND i - o.mean > 2),
k AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS k, count(*) OVER () AS n FROM j)
SELECT round(median(r), 8) AS ratio, count(*) AS rows, round(max(r) FILTER (k = 3 * n // 4) - max(r) FILTER (k = n // 4), 8) AS iqr,
  round(avg(CASE WHEN r BETWEEN 0 AND 1 THEN 0 ELSE 1 END) * 100, 8) AS outside_pct,
  CASE WHEN median(r) > 0.5 THEN 'loft follows the house' WHEN median(r) > 0.25 THEN 'between house and outdoors' ELSE 'loft follows outdoors' END AS verdict
  FROM k"""
)
def loft_ratio(spark, sf_dir):
    rows = means(spark, sf_dir)
    of = lambda name: rows.where(F.col("series_id") == name).select("sec", "value")
    out = air.loft_ratio(daily.hourly_over_any(rows, ROOMS, []), of(WATER), of(OUTDOOR), [], "UTC", LOFT)
    return out.select(r("ratio"), "rows", r("iqr"), r("outside_pct"), "verdict")


@query(f"""WITH {H}, f AS (SELECT series_id, sec, mean, count(*) OVER w AS n, max(mean) OVER w - min(mean) OVER w AS s
  FROM h
  WINDOW w AS (PARTITION BY series_id ORDER BY sec ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT series_id, sec, round(mean, 8) AS value FROM f WHERE NOT (n = 6 AND s < 25)""")
def flatline_drop(spark, sf_dir):
    return daily.drop_flatlines(means(spark, sf_dir), S, rows=6, span=25.0).select("series_id", "sec", r("value", 8))


@query(f"""WITH {HOUSE}, l AS (SELECT *, max(d) OVER (PARTITION BY home) - d AS age FROM hd)
SELECT home, count(*) FILTER (age < 30) AS days, round(avg(kwh) FILTER (age < 30), 8) AS kwh_per_day, round(avg(kwh), 8) AS historical,
  round(median(least) FILTER (age < 30) * 1000, 8) AS baseload_w, round(least(100,
  median(least) FILTER (age < 30) * 24 / avg(kwh) FILTER (age < 30) * 100), 8) AS share_pct, count(*) FILTER (age < 30) >= 14 AS usable
  FROM l
  GROUP BY 1""")
def electricity_baseload(spark, sf_dir):
    days = house_days(spark, sf_dir).select("home", "d", F.col("kwh").alias("total"), "least")
    return usage.electricity(days, HOME).select("home", "days", r("kwh_per_day"), r("historical"), r("baseload_w"), r("share_pct"), "usable")


@query(f"""WITH {BASE}, w AS (SELECT ho.*, lim, max(d) OVER (PARTITION BY home) - d AS age FROM ho JOIN li USING (home))
SELECT home, round(avg(water) FILTER (age < 7), 8) AS litres_7d, round(avg(water) FILTER (age < 30), 8) AS litres_30d,
  round(median(water) FILTER (age < 30), 8) AS typical_30d, count(*) FILTER (age < 30 AND water > lim) AS high_days, round(max(lim), 8) AS lim
  FROM w
  GROUP BY 1""")
def water_usage(spark, sf_dir):
    days = house_days(spark, sf_dir)
    rows = days.join(hotwater.outlier_limit(days, HOME), "home").withColumn("age", F.datediff(F.max("d").over(Window.partitionBy("home")), "d"))
    near = lambda n: F.when(F.col("age") < n, F.col("water"))
    out = rows.groupBy("home").agg(F.avg(near(7)).alias("litres_7d"), F.avg(near(30)).alias("litres_30d"), F.median(near(30)).alias("typical_30d"), F.count_if((F.col("age") < 30) & (F.col("water") > F.col("limit"))).alias("high_days"), F.max("limit").alias("lim"))
    return out.select("home", r("litres_7d"), r("litres_30d"), r("typical_30d"), "high_days", r("lim"))


@query(
    f"""WITH {HOUSE}, t AS (SELECT home, d, avg(kwh) OVER w7 AS a, count(*) OVER w7 AS n, avg(kwh) OVER w30 AS b, count(*) OVER w30 AS m,
  avg(kwh) OVER p30 AS c, count(*) OVER p30 AS k, median(kwh) OVER w30 AS md
  FROM hd
  WINDOW w7 AS (PARTITION BY home ORDER BY d RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW),
w30 AS (PARTITION BY home ORDER BY d RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW),
p30 AS (PARTITION BY home ORDER BY d RANGE BETWEEN INTERVAL 59 DAYS PRECEDING AND INTERVAL 30 DAYS PRECEDING))
SELECT home, d, round(CASE WHEN n >= 5 THEN a END, 8) AS last_7d, round(CASE WHEN m >= 20 THEN b END, 8) AS last_30d,
  round(CASE WHEN m >= 20 THEN md END, 8) AS typical_30d, round(CASE WHEN k >= 20 THEN c END, 8) AS previous_30d,
  round(CASE WHEN m >= 20 AND k >= 20 AND c <> 0 THEN (b - c) / c * 100 END, 8) AS change_pct, n AS days_7
  FROM t"""
)
def trailing_7_30(spark, sf_dir):
    t = lambda *a, **b: stats.trailing(None, HOME, "d", "kwh", *a, **b)
    rows = house_days(spark, sf_dir).withColumns({"last_7d": t(7, 5), "last_30d": t(30, 20), "typical_30d": t(30, 20, "median"), "previous_30d": t(30, 20, shift=30), "days_7": t(7, kind="count")})
    rows = rows.withColumn("change_pct", stats.change_pct(F.col("last_30d"), F.col("previous_30d")))
    return rows.select("home", "d", r("last_7d"), r("last_30d"), r("typical_30d"), r("previous_30d"), r("change_pct"), "days_7")


MODEL_DAY = """, md AS (SELECT home, max(d) AS md FROM hd WHERE delta_t > 4 AND q > 0.5 AND (heat_pct IS NULL OR heat_pct > 1) GROUP BY 1),
 ol AS (SELECT ho.*, md FROM ho JOIN md USING (home) WHERE d <= md AND md - d <= 365)"""
#: The attribution of days up to the last heated one, from nothing but those.
LOCKED_ATTRIBUTION = OFF + MODEL_DAY + ATTRIBUTED[len(OFF) :].replace("FROM ho)", "FROM ol)").replace("FROM ho ", "FROM ol ").replace("ho.", "ol.")


@query(f"WITH {LOCKED_ATTRIBUTION} SELECT home, max(md) AS model_day, count(*) AS days, round(avg(hot_kwh), 8) AS hot_kwh FROM a3 GROUP BY 1")
def season_lock(spark, sf_dir):
    days = report.season_locked(_off_days(spark, sf_dir), HOME, 365)
    rows = _attribution(days)
    return rows.groupBy("home").agg(F.max("model_day").alias("model_day"), F.count(F.lit(1)).alias("days"), F.round(F.avg("hot_kwh"), 8).alias("hot_kwh"))


@query(f"""WITH {HOUSE}, p AS (SELECT home, max(d) OVER (PARTITION BY home) - d AS age
  FROM hd
  WHERE q > 0.5 AND delta_t > 4),
c AS (SELECT home, count(*) FILTER (age <= 60) AS a, count(*) FILTER (age <= 120) AS b, count(*) FILTER (age <= 365) AS c
  FROM p
  GROUP BY 1)
SELECT home, (CASE WHEN a >= 70 THEN 60 WHEN b >= 70 THEN 120 ELSE 365 END)::INT AS window_days,
  CASE WHEN a >= 70 THEN a WHEN b >= 70 THEN b ELSE c END AS n
  FROM c""")
def expanding_window(spark, sf_dir):
    return heatloss.first_sufficient(heatloss.fit_points(house_days(spark, sf_dir)), HOME, [60, 120, 365], 70)


@query("""WITH a AS (SELECT o_custkey AS series_id, o_orderdate::DATE AS d, o_totalprice AS value, o_orderkey AS k,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS p
  FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY series_id, d ORDER BY p DESC, k DESC) AS n FROM a)
SELECT series_id, d, round(value, 8) AS value FROM b WHERE n = 1""")
def upsert_keep_last(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series_id"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "F").alias("new"))
    part = lambda flag: quality.keep_last(rows.where(F.col("new") if flag else ~F.col("new")), ["series_id", "d"], F.col("seq")).select("series_id", "d", "value")
    return quality.upsert(part(False), part(True), ["series_id", "d"]).select("series_id", "d", r("value"))


@query(
    """WITH e AS (SELECT event_type, user_id, floor(epoch(ts))::BIGINT AS sec, value, event_id FROM events),
l AS (SELECT user_id, sec, max_by(value, event_id) AS value
  FROM e
  WHERE event_type = 'purchase'
  GROUP BY 1, 2),
rr AS (SELECT user_id, sec, max_by(value, event_id) AS value FROM e WHERE event_type = 'view' GROUP BY 1, 2),
m AS (SELECT l.user_id, l.sec, l.value, rr.sec AS right_sec, rr.value AS right_value, row_number() OVER (PARTITION BY l.user_id,
  l.sec ORDER BY abs(l.sec - rr.sec), rr.sec) AS n
  FROM l
  LEFT JOIN rr ON l.user_id = rr.user_id AND abs(l.sec - rr.sec) <= 43200)
SELECT user_id, sec, round(value, 8) AS value, right_sec, round(right_value, 8) AS right_value
  FROM m
  WHERE n = 1"""
)
def asof_nearest(spark, sf_dir):
    second = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    events = table(spark, sf_dir, "events").select("user_id", second.alias("sec"), "value", "event_id", "event_type")
    of = lambda kind: quality.keep_last(events.where(F.col("event_type") == kind).drop("event_type"), ["user_id", "sec"], F.col("event_id")).drop("event_id")
    return alignment.nearest(of("purchase"), of("view"), ["user_id"], 43_200).select("user_id", "sec", r("value"), "right_sec", r("right_value"))


@query(
    f"""WITH {C}, p AS (SELECT a.sec, a.value - b.value AS diff
  FROM c a
  JOIN c b ON a.sec = b.sec AND a.series_id = 'click' AND b.series_id = 'view'),
m AS (SELECT median(diff) AS o, count(*) AS n FROM p)
SELECT n AS pairs, round(o, 8) AS offset_value, round(median(abs(diff - o)), 8) AS mad FROM p, m GROUP BY n, o"""
)
def baseline_offset(spark, sf_dir):
    rows = meter_rows(spark, sf_dir)
    of = lambda name: rows.where(F.col("series_id") == name).select("sec", "value")
    return quality.baseline_offset(of("view"), of("click"), [], 1800).select("pairs", F.round("offset", 8).alias("offset_value"), r("mad"))


@query(
    f"""WITH {C}, g AS (SELECT series_id, sec, value, sec - lag(sec) OVER w AS gap, value - lag(value) OVER w AS step
  FROM c
  WINDOW w AS (PARTITION BY series_id ORDER BY sec)),
k AS (SELECT series_id, median(gap) AS cad FROM g WHERE gap > 0 GROUP BY 1)
SELECT series_id, count(*) AS rows, min(sec) AS start, max(sec) AS \"end\", max(cad)::DOUBLE AS cadence_s, count(*) FILTER (gap > 1.5 * cad) AS gaps,
  count(*) FILTER (step < 0) AS negative, count(*) FILTER (step > 400) AS over,
  coalesce(count(*) FILTER (step < 0) >= 2 AND count(*) FILTER (step > 400) >= 2 AND abs(median(step) FILTER (step > 400) - median(-step) FILTER (step < 0)) <= greatest(400,
  0.1 * greatest(median(step) FILTER (step > 400), median(-step) FILTER (step < 0))), false) AS mixed
  FROM g
  JOIN k USING (series_id)
  GROUP BY 1"""
)
def cadence_audit(spark, sf_dir):
    return quality.audit(meter_rows(spark, sf_dir), S, 400.0)


@query(
    f"""WITH {H}, s AS (SELECT series_id, (sec // 7200) * 7200 AS sec, avg(mean) AS v FROM h GROUP BY 1, 2),
sp AS (SELECT series_id, unnest(range(min(sec), max(sec) + 1, 7200)) AS sec FROM s GROUP BY 1),
j AS (SELECT sp.series_id, sp.sec, v FROM sp LEFT JOIN s USING (series_id, sec))
SELECT series_id, sec, round(last_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY sec ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
  8) AS value, v IS NULL AS filled
  FROM j"""
)
def grid_ffill(spark, sf_dir):
    return alignment.on_grid(means(spark, sf_dir), S, 7200, 2).select("series_id", "sec", r("value", 8), "filled")


INTERP = f"""WITH {H}, sp AS (SELECT series_id, unnest(range(min(sec), max(sec) + 1, 3600)) AS sec FROM h GROUP BY 1),
 j AS (SELECT sp.series_id, sp.sec, mean AS v, row_number() OVER (PARTITION BY sp.series_id ORDER BY sp.sec) AS i
  FROM sp
  LEFT JOIN h USING (series_id, sec)),
 x AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, last_value(v IGNORE NULLS) OVER b AS v0,
   first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1, first_value(v IGNORE NULLS) OVER a AS v1
  FROM j
   WINDOW b AS (PARTITION BY series_id ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY sec ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, sec, round(CASE WHEN v IS NOT NULL THEN v WHEN i - i0 <= 1 THEN v0 + coalesce((v1 - v0) * (i - i0) / (i1 - i0), 0) END, 8) AS value
  FROM x"""


@query(INTERP)
def interpolate_limit(spark, sf_dir):
    grid = alignment.on_grid(means(spark, sf_dir), S, 3600, 0).select("series_id", "sec", "value")
    return alignment.interpolated(grid, S, 1).select("series_id", "sec", r("value", 8))


@query(f"WITH {H} SELECT series_id, (sec // 604800) * 604800 AS sec, round(avg(mean), 8) AS value, count(*) AS n FROM h GROUP BY 1, 2")
def weekly_mean(spark, sf_dir):
    return alignment.bucket_mean(means(spark, sf_dir), S, 604_800).select("series_id", "sec", r("value"), "n")


@query(f"""WITH {HOUSE}, v AS (SELECT home, d, q / delta_t * 1000 / 24 AS hlc FROM hd WHERE delta_t > 4)
SELECT home, d, CASE WHEN hlc < 100 THEN 'excellent' WHEN hlc < 180 THEN 'good' WHEN hlc < 280 THEN 'fair' WHEN hlc < 400 THEN 'poor' ELSE 'beyond' END AS band
  FROM v""")
def gauge_bands(spark, sf_dir):
    """Bands of each day's own loss for a kelvin."""
    days = house_days(spark, sf_dir).where("delta_t > 4")
    return days.select("home", "d", report.band(F.col("q") / F.col("delta_t") * 1000 / 24, report.HLC_BANDS).alias("band"))


@query(f"""WITH {TAU}, s AS (SELECT home, room, median(tau_h) FILTER (rejection_reason IS NULL) AS tau_median_h
  FROM tf
  GROUP BY 1, 2)
SELECT home, room, tau_median_h, row_number() OVER (PARTITION BY home ORDER BY tau_median_h NULLS LAST, room)::INT AS place,
  CASE WHEN tau_median_h IS NOT NULL THEN row_number() OVER (PARTITION BY home ORDER BY tau_median_h DESC NULLS LAST, room)::INT END AS slowest_place
  FROM s""")
def room_rank(spark, sf_dir):
    return report.ranked(cooling.summary(_night_fits(spark, sf_dir), HOME).select("home", "room", "tau_median_h"), HOME)


@query(
    """WITH u AS (SELECT o_orderkey, o_totalprice AS v,
  CASE o_orderkey % 4 WHEN 0 THEN 'GBP/kWh' WHEN 1 THEN 'p / kWh' WHEN 2 THEN 'gbp/MWh' ELSE 'EUR/kWh' END AS unit
  FROM orders)
SELECT o_orderkey, round(CASE o_orderkey % 4 WHEN 0 THEN v WHEN 1 THEN v / 100 WHEN 2 THEN v / 1000 END, 8) AS rate
  FROM u"""
)
def tariff_normalise(spark, sf_dir):
    unit = F.when(F.col("o_orderkey") % 4 == 0, "GBP/kWh").when(F.col("o_orderkey") % 4 == 1, "p / kWh").when(F.col("o_orderkey") % 4 == 2, "gbp/MWh").otherwise("EUR/kWh")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(usage.tariff_per_kwh(F.col("o_totalprice").cast("string"), unit), 8).alias("rate"))
