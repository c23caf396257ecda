"""Air changes from falling CO2, loss split and loft ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import lower_quartile, ols, upper_quartile
from ..thresholds import AIR_WH_PER_M3_K, AirChange, Loft
from .alignment import interpolated
from .chunks import CHUNK_S, along, carried, inside, with_previous
from .daily import drop_flatlines
from .meters import Zone, local_time
from .ranks import at_ranks, floor_rank


def baseline_ppm(readings: DataFrame, by: list[str], rule: AirChange = AirChange(), measured: DataFrame | None = None, configured: float | str | None = None) -> DataFrame:
    """(by, baseline, baseline_source): the median of the home's outdoor sensor,
    else the configured value, else a low percentile of the readings. ``measured``
    meets on the columns of ``by`` that it has, such as the home; ``configured`` may
    be the column of the readings that holds each home's value."""
    set_ = F.max(configured) if isinstance(configured, str) else F.max(F.lit(configured).cast("double"))
    own = at_ranks(readings, by, "value", {"low": floor_rank(rule.baseline_p)}).drop("n")
    own = own.join(readings.groupBy(*by).agg(set_.alias("set")), by)
    if measured is not None:
        home = [c for c in by if c in measured.columns]
        outdoors = measured.groupBy(*home).agg(F.median("value").alias("out"))
        own = own.join(outdoors, home, "left") if home else own.crossJoin(outdoors)  # one row
    else:
        own = own.withColumn("out", F.lit(None).cast("double"))
    fixed = F.col("set")
    source = F.when(F.col("out").isNotNull(), "sensor").when(fixed.isNotNull(), "configured").otherwise("percentile")
    return own.select(*by, F.coalesce("out", fixed, "low").alias("baseline"), source.alias("baseline_source"))


def falling_runs(readings: DataFrame, by: list[str], rule: AirChange = AirChange(), chunk_s: int = CHUNK_S) -> DataFrame:
    """Adds ``run``: readings that follow within ``max_gap_s`` and don't rise by
    more than the noise belong to one run. Runs are counted inside chunks, and
    the chunks' counts are summed along the series."""
    breaks = (F.col("sec") - F.col("__prev.sec") > rule.max_gap_s) | (F.col("value") > F.col("__prev.value") + rule.noise_ppm)
    marked = with_previous(readings, by, chunk_s=chunk_s).withColumn("__b", F.coalesce(breaks, F.lit(True)).cast("long"))
    sums = F.sum("n").over(along(by).rowsBetween(Window.unboundedPreceding, -1))
    counted = carried(marked, by, {"n": F.sum("__b")}, {"__before": F.coalesce(sums, F.lit(0))})
    return counted.withColumn("run", F.col("__before") + F.sum("__b").over(inside(by))).select(*readings.columns, "run")


def decay_fits(readings: DataFrame, baselines: DataFrame, by: list[str], rule: AirChange = AirChange()) -> DataFrame:
    """One row a run: points, seconds, slope and r2 of ln(excess) on hours, and
    whether the run counts."""
    runs = falling_runs(readings, by, rule).join(baselines.select(*by, "baseline"), by)
    excess = F.col("value") - F.col("baseline")
    hours = (F.col("sec") - F.min("sec").over(Window.partitionBy(*by, "run"))) / 3600.0
    points = runs.withColumns({"hours": hours, "log_excess": F.when(excess > 0, F.ln(excess)), "excess": excess})
    fits = points.groupBy(*by, "run").agg(
        F.count(F.lit(1)).alias("points"), (F.max("sec") - F.min("sec")).alias("seconds"), F.min_by("excess", "sec").alias("first_excess"), F.min("excess").alias("least_excess"),
        *ols("log_excess", "hours"),
    )
    able = (F.col("seconds") >= rule.min_window_s) & (F.col("first_excess") >= rule.min_excess) & (F.col("least_excess") > 0)
    return fits.withColumn("counts", able & (F.col("slope") < 0) & (F.col("r2") >= rule.min_r2)).drop("n", "sxx", "x_spread", "intercept")


def air_change_rate(fits: DataFrame, by: list[str], rule: AirChange = AirChange()) -> DataFrame:
    """(by, ach, windows, usable) of each sensor."""
    rate = F.when(F.col("counts"), -F.col("slope"))
    out = fits.groupBy(*by).agg(F.median(rate).alias("ach"), F.count(rate).alias("windows"))
    return out.withColumn("usable", F.coalesce((F.col("windows") >= rule.min_windows) & F.col("ach").between(*rule.bounds), F.lit(False)))


def combine(rates: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rates.groupBy(*(by or [])).agg(F.median("ach").alias("ach"), F.sum("windows").alias("windows"), F.median("baseline").alias("baseline"), F.count(F.lit(1)).alias("sensors"))


def split_losses(df: DataFrame, hlc: str, ach: str, volume_m3: Column) -> DataFrame:
    """Adds ventilation_w_per_k, fabric_w_per_k and share_pct; null where the
    ventilation would be more than the whole."""
    vent = F.col(ach) * volume_m3 * AIR_WH_PER_M3_K
    fits = vent <= F.col(hlc)
    return df.withColumns({"ventilation_w_per_k": F.when(fits, vent), "fabric_w_per_k": F.when(fits, F.col(hlc) - vent), "share_pct": F.when(fits, F.try_divide(vent, F.col(hlc)) * 100)})


def gates(df: DataFrame, rule: Loft = Loft()) -> Column:
    """Whether ratios (ratio, rows, iqr, outside_pct) may be reported."""
    steady = (F.col("iqr") <= rule.max_iqr) & (F.col("outside_pct") <= rule.max_outside * 100)
    return (F.col("rows") >= rule.min_rows) & F.col("ratio").between(0, 1) & steady


def loft_ratio_filled(inside: DataFrame, loft: DataFrame, outdoor: DataFrame, by: list[str], tz: Zone, rule: Loft = Loft(), most: int = 24) -> DataFrame:
    """Like ``loft_ratio`` over all stamps of the three series, each one's gaps
    filled on a line for up to ``most`` stamps, with interpolated quartiles."""
    name = lambda df, n: df.select(*by, "sec", F.col("value").alias(n))
    met = name(inside, "i").join(name(loft, "l"), [*by, "sec"], "full").join(name(outdoor, "o"), [*by, "sec"], "full")
    for column in "ilo":
        met = interpolated(met, by, most, column)
    whole = met.where("i is not null and l is not null and o is not null")
    night = F.hour(local_time(F.col("sec"), tz)).between(*rule.hours)
    rows = whole.where(night & (F.col("i") - F.col("o") > rule.min_delta_t)).withColumn("r", (F.col("l") - F.col("o")) / (F.col("i") - F.col("o")))
    outside = (~F.col("r").between(0, 1)).cast("double")
    out = rows.groupBy(*by).agg(
        F.median("r").alias("ratio"),
        F.count("r").alias("rows"),
        (F.percentile("r", 0.75) - F.percentile("r", 0.25)).alias("iqr"),
        (F.avg(outside) * 100).alias("outside_pct"),
    )
    return out.withColumn("usable", gates(out, rule))


def loft_ratio(inside: DataFrame, loft: DataFrame, outdoor: DataFrame, by: list[str], tz: Zone, rule: Loft = Loft()) -> DataFrame:
    """(by, ratio, rows, iqr, outside_pct, verdict, usable) over cold night hours."""
    name = lambda df, n: df.select(*by, "sec", F.col("value").alias(n))
    met = name(inside, "i").join(name(loft, "l"), [*by, "sec"]).join(name(outdoor, "o"), [*by, "sec"])
    cold = met.where(F.hour(local_time(F.col("sec"), tz)).between(*rule.hours) & (F.col("i") - F.col("o") > rule.min_delta_t))
    rows = cold.withColumn("r", (F.col("l") - F.col("o")) / (F.col("i") - F.col("o")))
    out = rows.groupBy(*by).agg(
        F.median("r").alias("ratio"), F.count("r").alias("rows"), (upper_quartile("r") - lower_quartile("r")).alias("iqr"), (F.avg((~F.col("r").between(0, 1)).cast("double")) * 100).alias("outside_pct")
    )
    verdict = F.when(F.col("ratio") > 0.5, "loft follows the house").when(F.col("ratio") > 0.25, "between house and outdoors").otherwise("loft follows outdoors")
    return out.withColumns({"usable": gates(out, rule), "verdict": verdict})


def loft_report(inside: DataFrame, loft: DataFrame, outdoor: DataFrame, homes: DataFrame, by: list[str], tz: Zone, humidity: DataFrame | None = None, rule: Loft = Loft()) -> DataFrame:
    """(by, ratio, verdict, hours_used, window_days, iqr, out_of_range_pct,
    humidity_pct, unavailable_reason) of every home of ``homes`` (by, today,
    window_days, loft_since).

    Readings count from the window's first day, or from the day on which the
    sensor moved to the loft if that is later; a sensor that stands still is left
    out. A home whose ratio a gate rejects keeps its row and has no values.
    """
    cutoff = F.greatest(F.date_sub("today", F.col("window_days")), F.coalesce("loft_since", F.date_sub("today", F.col("window_days"))))
    begun = homes.select(*by, cutoff.alias("__from"))
    since = lambda rows: rows.join(begun, by).where(local_time(F.col("sec"), tz).cast("date") >= F.col("__from")).drop("__from")
    moving = since(drop_flatlines(loft, by))
    found = loft_ratio(inside, moving, outdoor, by, tz, rule)
    out = homes.select(*by, "window_days").join(found, by, "left")
    if humidity is not None:
        latest = since(humidity).groupBy(*by).agg(F.max_by("value", "sec").alias("humidity"))
        out = out.join(latest, by, "left")
    else:
        out = out.withColumn("humidity", F.lit(None).cast("double"))
    ok = F.coalesce("usable", F.lit(False))
    shown = lambda c: F.when(ok, F.col(c))
    return out.select(
        *by, shown("ratio").alias("ratio"), shown("verdict").alias("verdict"), shown("rows").alias("hours_used"), shown("window_days").alias("window_days"), shown("iqr").alias("iqr"),
        shown("outside_pct").alias("out_of_range_pct"), shown("humidity").alias("humidity_pct"), F.when(~ok, "not enough cold night hours").alias("unavailable_reason"),
    )
