"""Overnight cooling: time constants by grid search over a simulated decay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..thresholds import Cooling
from .meters import Zone, local_time


def nights(readings: DataFrame, rooms: DataFrame, outdoor: DataFrame, by: list[str], tz: Zone, rule: Cooling = Cooling(), heat: DataFrame | None = None) -> DataFrame:
    """(by, room, d, points, rejection_reason): each room's night with its sorted
    points (sec, temp, out). ``rooms`` has room, temp_series, heat_series (null
    if the room has none), and those columns of ``by`` that its ids are unique in;
    a configured series without rows rejects its nights.
    """
    of = lambda df, name: df.select(*[F.col(c) for c in by], "sec", *(["series_id"] if "series_id" in df.columns else []), F.col("value").alias(name))
    met = of(readings, "temp").join(rooms.withColumnRenamed("temp_series", "series_id"), [*(c for c in by if c in rooms.columns), "series_id"]).drop("series_id")
    met = met.join(of(outdoor, "out").drop("series_id"), [*by, "sec"], "left")
    if heat is None:
        met = met.withColumn("heat", F.lit(None).cast("double"))
    else:
        met = met.join(of(heat, "heat").withColumnRenamed("series_id", "heat_series"), [*by, "sec", "heat_series"], "left")
    local = local_time(F.col("sec"), tz)
    met = met.withColumn("d", local.cast("date")).where(F.hour(local).between(*rule.hours))
    grouped = met.groupBy(*by, "room", "heat_series", "d").agg(
        F.array_sort(F.collect_list(F.struct("sec", "temp", "out"))).alias("points"), F.count(F.lit(1)).alias("n"), F.count("out").alias("n_out"),
        F.count("heat").alias("n_heat"), F.max("heat").alias("most_heat"), F.min(F.col("temp") - F.col("out")).alias("least_dt"),
    )
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("points") - 1, F.lit(1))), lambda i: F.coalesce(F.get("points", i)["sec"] - F.get("points", i - 1)["sec"], F.lit(0)))
    drop = F.get("points", F.lit(0))["temp"] - F.element_at("points", -1)["temp"]
    reason = (
        F.when(F.col("n") < rule.min_points, "too few points")
        .when(F.array_max(gaps) > rule.max_gap_s, "gap")
        .when(F.col("n_out") < F.col("n"), "no outdoor temperature")
        .when(F.col("heat_series").isNotNull() & (F.col("n_heat") < F.col("n") * rule.heat_coverage), "heating unknown")
        .when(F.col("heat_series").isNotNull() & (F.col("most_heat") > rule.max_heat_pct), "heated")
        .when(F.col("least_dt") < rule.min_delta_t, "too warm outside")
        .when(drop < rule.min_drop, "no drop")
    )
    return grouped.select(*by, "room", "d", "points", F.col("n").alias("n_points"), reason.alias("rejection_reason"))


def fit_tau(night_rows: DataFrame, rule: Cooling = Cooling()) -> DataFrame:
    """Adds tau_h, sse, r2 and a final rejection_reason.

    Each step relaxes towards the mean outdoor temperature of its ends. For every
    constant on the grid the simulated temperatures' squared error is summed by
    an aggregate over the points; the least error wins, then the smallest constant.
    The search takes time rather than bytes, so nights are dealt to all tasks.
    """
    low, high, by = rule.grid
    temps = F.transform("points", lambda p: p["temp"])
    steps = F.transform(
        F.sequence(F.lit(1), F.size("points") - 1),
        lambda i: F.struct(
            ((F.get("points", i)["sec"] - F.get("points", i - 1)["sec"]) / 3600.0).alias("h"),
            ((F.get("points", i)["out"] + F.get("points", i - 1)["out"]) / 2).alias("b"),
            F.get("points", i)["temp"].alias("t"),
        ),
    )
    tasks = int(night_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = night_rows.repartition(tasks, *(c for c in night_rows.columns if c not in ("points", "n_points", "rejection_reason")))
    ready = dealt.withColumns({"__steps": F.when(F.col("rejection_reason").isNull(), steps), "__t": temps})
    first = F.get("__t", F.lit(0))

    def error(tau):
        # a step adds the error of the one before, so each takes one exponential
        missed = lambda acc: acc["sse"] + (acc["m"] - acc["t"]) * (acc["m"] - acc["t"])

        def step(acc, s):
            m = s["b"] + (acc["m"] - s["b"]) * F.exp(-s["h"] / tau)
            return F.struct(m.alias("m"), s["t"].alias("t"), missed(acc).alias("sse"))

        begun = F.struct(first.alias("m"), first.alias("t"), F.lit(0.0).alias("sse"))
        return F.struct(F.aggregate("__steps", begun, step, missed).alias("sse"), tau.alias("tau"))

    grid = F.transform(F.sequence(F.lit(round(low / by)), F.lit(round(high / by))), lambda k: error(k * by))
    fitted = ready.withColumn("__best", F.when(F.col("__steps").isNotNull(), F.array_min(grid)))
    mean = F.aggregate("__t", F.lit(0.0), lambda a, t: a + t) / F.size("__t")
    fitted = fitted.withColumn("__mean", mean)
    total = F.aggregate("__t", F.lit(0.0), lambda a, t: a + (t - F.col("__mean")) * (t - F.col("__mean")))
    r2 = F.coalesce(1 - F.try_divide(F.col("__best.sse"), total), F.lit(0.0))
    out = fitted.withColumns({"tau_h": F.col("__best.tau"), "sse": F.col("__best.sse"), "r2": F.when(F.col("__best").isNotNull(), r2)})
    reason = F.coalesce(F.col("rejection_reason"), F.when(F.col("tau_h") >= high, "at the end of the grid").when(F.col("r2") < rule.min_r2, "weak fit"))
    return out.withColumn("rejection_reason", reason).drop("__steps", "__t", "__best", "__mean")


def summary(fits: DataFrame, by: list[str], rooms: DataFrame | None = None) -> DataFrame:
    """(by, room, nights_fitted, tau_median_h, tau_min_h, tau_max_h, last_night)
    of every room that has nights; with ``rooms`` (by, room) of all of these, with
    0 nights where there are none."""
    good = F.col("rejection_reason").isNull()
    tau = F.when(good, F.col("tau_h"))
    out = fits.groupBy(*by, "room").agg(
        F.count(tau).alias("nights_fitted"), F.median(tau).alias("tau_median_h"), F.min(tau).alias("tau_min_h"), F.max(tau).alias("tau_max_h"), F.max(F.when(good, F.col("d"))).alias("last_night")
    )
    if rooms is None:
        return out
    return rooms.select(*by, "room").distinct().join(out, [*by, "room"], "left").withColumn("nights_fitted", F.coalesce("nights_fitted", F.lit(0)))


def long_nights(readings: DataFrame, outdoor: DataFrame, by: list[str], tz: Zone, start_h: float = 23.5, end_h: float = 6.5, max_gap_s: int = 600, min_hours: float = 3.0, min_delta_t: float = 3.0, min_drop: float = 0.3, heat: DataFrame | None = None, max_heat_pct: float = 1.0, heat_coverage: float = 0.8) -> DataFrame:
    """(by, d, points, n_points, rejection_reason) of nights across midnight,
    named for the evening they begin on, for ``fit_tau``.

    ``outdoor`` has those columns of ``by`` that it is told by, such as the home.
    Readings without an outdoor one at their stamp go. Nights that the readings
    don't span whole are left out.
    """
    named = lambda df, n: df.select(*by, "sec", F.col("value").alias(n))
    rows = named(readings, "temp")
    rows = rows.join(named(heat, "heat"), [*by, "sec"], "left") if heat is not None else rows.withColumn("heat", F.lit(None).cast("double"))
    shared = [c for c in by if c in outdoor.columns]
    rows = rows.join(outdoor.select(*shared, "sec", F.col("value").alias("out")), [*shared, "sec"], "left")
    local = local_time(F.col("sec"), tz)
    hour = F.hour(local) + F.minute(local) / 60 + F.second(local) / 3600
    day = F.when(hour >= start_h, local.cast("date")).when(hour <= end_h, F.date_sub(local.cast("date"), 1))
    at = lambda d, h: F.timestamp_add("SECOND", F.lit(int(h * 3600)), d.cast("timestamp_ntz"))
    spans = rows.groupBy(*by).agg(F.min(local).alias("__first"), F.max(local).alias("__last"))
    inside = rows.withColumn("d", day).where(F.col("d").isNotNull())
    spanned = inside.join(spans, by) if by else inside.crossJoin(spans)  # one row
    spanned = spanned.where((at(F.col("d"), start_h) >= F.col("__first")) & (at(F.date_add("d", 1), end_h) <= F.col("__last")))
    both = F.col("out").isNotNull()
    point = F.when(both, F.struct("sec", "temp", "out"))
    nights_ = spanned.groupBy(*by, "d").agg(
        F.array_sort(F.collect_list(point)).alias("points"),
        F.count("out").alias("n_points"),
        F.count(F.lit(1)).alias("n"),
        F.count("heat").alias("n_heat"),
        F.max("heat").alias("most_heat"),
        F.min(F.col("temp") - F.col("out")).alias("least_dt"),
    )
    seconds = lambda i: F.get("points", i)["sec"]
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("points") - 1, F.lit(1))), lambda i: F.coalesce(seconds(i) - seconds(i - 1), F.lit(0)))
    hours = (F.element_at("points", -1)["sec"] - F.get("points", F.lit(0))["sec"]) / 3600
    drop = F.get("points", F.lit(0))["temp"] - F.element_at("points", -1)["temp"]
    reason = F.when(F.col("n_points") == 0, "no points")
    if heat is not None:
        reason = reason.when(F.col("n_heat") < F.col("n") * heat_coverage, "heating unknown").when(F.col("most_heat") > max_heat_pct, "heated")
    reason = (
        reason.when(F.array_max(gaps) > max_gap_s, "gap")
        .when(hours < min_hours, "too short")
        .when(F.col("least_dt") < min_delta_t, "too warm outside")
        .when(drop < min_drop, "no drop")
    )
    return nights_.select(*by, "d", "points", "n_points", reason.alias("rejection_reason"))


def in_windows(fits: DataFrame, by: list[str], windows: DataFrame, rooms: DataFrame | None = None, min_nights: int = Cooling.min_nights) -> DataFrame:
    """(by, room, tau_median_h, nights_fitted, last_night, window_days) of fitted
    nights by the shortest window with ``min_nights`` good ones, else the longest.

    ``windows`` has by, today and windows, an array of lengths in days: a night
    counts in those that reach back to it. Each night is fitted once and goes to
    its windows; medians are exact. Pass stored fits: Catalyst would repeat the
    search in the filter of good nights. With ``rooms`` (by, room) rooms without a good
    night keep their row, without values.
    """
    good = fits.where("rejection_reason is null").join(windows, by)
    reach = F.filter("windows", lambda w: F.datediff("today", "d") <= w)
    spread = good.select(*by, "room", "d", "tau_h", F.array_max("windows").alias("longest"), F.explode(reach).alias("w"))
    each = spread.groupBy(*by, "room", "w").agg(F.median("tau_h").alias("tau"), F.count(F.lit(1)).alias("n"), F.max("d").alias("last"), F.max("longest").alias("longest"))
    enough = (F.col("n") >= min_nights) | (F.col("w") == F.col("longest"))
    best = each.groupBy(*by, "room").agg(F.min(F.when(enough, F.struct("w", "tau", "n", "last"))).alias("best"))
    out = best if rooms is None else rooms.select(*by, "room").distinct().join(best, [*by, "room"], "left")
    return out.select(
        *by, "room", F.col("best.tau").alias("tau_median_h"), F.coalesce("best.n", F.lit(0)).cast("long").alias("nights_fitted"), F.col("best.last").alias("last_night"), F.col("best.w").alias("window_days")
    )
