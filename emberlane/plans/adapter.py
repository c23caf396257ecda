"""Telemetry roles played by the driver's tables, in Spark and in SQL.

``hourly``: each event type is a series with an hourly mean, an increment and a
cumulative meter. ``house_days``: ship days of each return flag are a home's
days, with weather by the calendar and use by what was shipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOMS = ["view", "click"]
OUTDOOR, GAS, WATER = "error", "purchase", "signup"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, sec, mean, inc)"""
    second = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    hour = (F.floor(second / 3600) * 3600).cast("long")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), hour.alias("sec")).agg(F.avg("value").alias("mean"), F.sum("value").alias("inc"))


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).select("series_id", "sec", F.col("mean").alias("value"))


def meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, sec, value): the running sum of each series' increments."""
    running = F.sum("inc").over(Window.partitionBy("series_id").orderBy("sec"))
    return hourly(spark, sf_dir).select("series_id", "sec", running.alias("value"))


def house_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(home, d, outdoor, delta_t, water, heat_pct, q, kwh, least)"""
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("home"), F.col("l_shipdate").cast("date").alias("d")).agg(F.sum("l_quantity").alias("s"), F.count(F.lit(1)).alias("n"))
    outdoor = 10 - 8 * F.cos(F.dayofyear("d") * 2 * 3.141592653589793 / 365) + (F.col("s") % 7) / 2 - 1.5
    days = days.withColumn("outdoor", outdoor).withColumns(
        {
            "delta_t": F.greatest(20 - F.col("outdoor"), F.lit(0.0)),
            "water": F.when(F.col("n") % 11 == 0, 5.0).otherwise(100 + (F.col("s") * 13) % 400),
        }
    )
    days = days.withColumn("heat_pct", F.when(F.col("n") % 4 != 0, F.when(F.col("delta_t") < 6, 0.5).otherwise(30.0)))
    return days.select(
        "home", "d", "outdoor", "delta_t", "water", "heat_pct",
        (3 + F.when(F.col("delta_t") > 4, 5.5 * F.col("delta_t")).otherwise(0.0) + (F.col("s") % 5) / 2 + F.col("water") * 0.02).alias("q"),
        (6 + (F.col("s") % 9)).alias("kwh"), (0.1 + (F.col("n") % 5) * 0.02).alias("least"),
    )


H = """h AS (SELECT event_type AS series_id, (epoch(date_trunc('hour', ts)))::BIGINT AS sec, avg(value) AS mean, sum(value) AS inc FROM events GROUP BY 1, 2)"""
C = H + """, c AS (SELECT series_id, sec, sum(inc) OVER (PARTITION BY series_id ORDER BY sec) AS value FROM h)"""
#: steps of meters; {0} is the largest one allowed
STEPS = C + """, g AS (SELECT series_id, sec, sec - lag(sec) OVER w AS gap, value - lag(value) OVER w AS step
  FROM c
  WINDOW w AS (PARTITION BY series_id ORDER BY sec)),
 st AS (SELECT series_id, sec, step FROM g WHERE gap > 0 AND gap <= 5400 AND step >= 0 AND step <= {0})"""
DAY = "(TIMESTAMP '1970-01-01' + to_seconds({0}))::DATE"
HOUSE = """b AS (SELECT l_returnflag AS home, l_shipdate::DATE AS d, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2),
 b1 AS (SELECT *, 10 - 8 * cos(dayofyear(d) * 2 * 3.141592653589793::DOUBLE / 365) + (s % 7) / 2 - 1.5 AS outdoor FROM b),
 b2 AS (SELECT *, greatest(20 - outdoor, 0.0::DOUBLE) AS delta_t, CASE WHEN n % 11 = 0 THEN 5.0::DOUBLE ELSE 100 + (s * 13) % 400 END AS water
  FROM b1),
 b3 AS (SELECT *, CASE WHEN n % 4 <> 0 THEN CASE WHEN delta_t < 6 THEN 0.5::DOUBLE ELSE 30.0::DOUBLE END END AS heat_pct FROM b2),
 hd AS (SELECT home, d, outdoor, delta_t, water, heat_pct,
   3 + CASE WHEN delta_t > 4 THEN 5.5::DOUBLE * delta_t ELSE 0 END + (s % 5) / 2 + water * 0.02::DOUBLE AS q,
   6 + (s % 9) AS kwh, 0.1::DOUBLE + (n % 5) * 0.02::DOUBLE AS least FROM b3)"""
OFF = HOUSE + """, ho AS (SELECT *, CASE WHEN heat_pct IS NOT NULL THEN heat_pct <= 1.0 ELSE delta_t < 3 END AS off FROM hd)"""


#: Zones of the homes, whose clocks change on different days, and hours from UTC to 22 o'clock of each.
HOME_ZONES = {"A": ("America/New_York", 3), "N": ("Europe/London", 22), "R": ("Asia/Kolkata", 17)}


def zone_of(home: str = "home"):
    """(zone, hour at which the heating goes off in UTC) of a home, as columns."""
    pick = lambda i: F.coalesce(*(F.when(F.col(home) == k, F.lit(v[i])) for k, v in HOME_ZONES.items()))
    return pick(0), pick(1)


def house_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(home, zone, sec, room_a, room_b, outdoor, heat_a, loft, humidity, co2, litres, gas):
    the hours of ``house_days``' homes. Rooms cool from 22 o'clock, each day with
    constants of its own; the loft follows, CO2 falls, and some gas goes with the litres."""
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("home"), F.col("l_shipdate").cast("date").alias("d")).agg(F.sum("l_quantity").alias("s"), F.count(F.lit(1)).alias("n"))
    outdoor = 10 - 8 * F.cos(F.dayofyear("d") * 2 * 3.141592653589793 / 365) + (F.col("s") % 7) / 2 - 1.5
    hours = days.withColumn("outdoor", outdoor).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    zone, off = zone_of()
    p = (F.col("h") - off + 24) % 24
    fall = lambda tau: F.col("outdoor") + (21 - F.col("outdoor")) * F.exp(-F.col("p") / tau)
    hours = hours.withColumns({"zone": zone, "p": p, "sec": F.datediff("d", F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.col("h") * 3600})
    litres = ((F.col("n") * (F.col("h") + 1)) % 13).cast("double")
    hours = hours.withColumns({"room_a": fall(10.0 + F.col("n") % 25), "room_b": fall(30.0 + F.col("s") % 50)})
    return hours.select(
        "home", "zone", "sec", "room_a", "room_b", "outdoor",
        F.when(F.col("n") % 5 != 0, F.when(F.col("p") >= 18, 40.0).otherwise(0.0)).alias("heat_a"),
        (F.col("outdoor") + (0.2 + (F.col("n") % 7) / 20) * (F.col("room_a") - F.col("outdoor"))).alias("loft"),
        F.when(F.col("h") % 6 == 0, 55.0 + F.col("s") % 30).alias("humidity"),
        (420 + 700 * F.exp(-F.col("p") * (0.2 + (F.col("n") % 4) / 20))).alias("co2"),
        litres.alias("litres"), (0.1 + 0.018 * litres + (F.col("s") + F.col("h")) % 3 * 0.01).alias("gas"),
    )


def series_of(hours: DataFrame, *names: str) -> DataFrame:
    """(home, zone, series_id, sec, value) of these columns of ``house_hours``."""
    parts = F.array(*(F.struct(F.lit(n).alias("series_id"), F.col(n).alias("value")) for n in names))
    return hours.select("home", "zone", "sec", F.inline(parts)).where("value is not null")


ZONES_SQL = "CASE home " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in HOME_ZONES.items()) + " END"
_OFF_SQL = "CASE home " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in HOME_ZONES.items()) + " END"
#: Local wall-clock time of {0} seconds in column zone.
LOCAL = "timezone(zone, timezone('UTC', TIMESTAMP '1970-01-01' + to_seconds({0})))"
HOURS = f"""hb AS (SELECT l_returnflag AS home, l_shipdate::DATE AS d, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2),
hb1 AS (
  SELECT home, d, s, n, h, {ZONES_SQL} AS zone, (h - {_OFF_SQL} + 24) % 24 AS p, (d - DATE '1970-01-01')::BIGINT * 86400 + h * 3600 AS sec,
    10 - 8 * cos(dayofyear(d) * 2 * 3.141592653589793::DOUBLE / 365) + (s % 7) / 2 - 1.5 AS outdoor
  FROM hb, range(24) r(h)),
hb2 AS (
  SELECT *, outdoor + (21 - outdoor) * exp(-p / (10.0::DOUBLE + n % 25)) AS room_a, outdoor + (21 - outdoor) * exp(-p / (30.0::DOUBLE + s % 50)) AS room_b
  FROM hb1),
hh AS (
  SELECT home, zone, sec, room_a, room_b, outdoor, CASE WHEN n % 5 <> 0 THEN CASE WHEN p >= 18 THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END END AS heat_a,
    outdoor + (0.2::DOUBLE + (n % 7) / 20) * (room_a - outdoor) AS loft, CASE WHEN h % 6 = 0 THEN 55.0::DOUBLE + s % 30 END AS humidity,
    420 + 700 * exp(-p * (0.2::DOUBLE + (n % 4) / 20)) AS co2,
    ((n * (h + 1)) % 13)::DOUBLE AS litres, 0.1::DOUBLE + 0.018::DOUBLE * ((n * (h + 1)) % 13) + (s + h) % 3 * 0.01::DOUBLE AS gas
  FROM hb2)"""
